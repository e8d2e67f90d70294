"""Choosing the answer of an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions import text


def reaction_score(reactions: Column) -> Column:
    names = ("+1", "heart", "hooray")
    return sum((F.coalesce(reactions.getField(name), F.lit(0)) for name in names), F.lit(0))


def best_comment(comments: Column) -> Column:
    """The non-blank comment with most reactions, the first of equals, stripped; NULL if none.

    Works inside the comment array: a struct of (score, -position, body) makes
    the largest element the wanted one.
    """
    scored = F.transform(
        comments,
        lambda c, i: F.struct(
            reaction_score(c.getField("reactions")).alias("score"),
            (-i).alias("order"),
            text.strip(text.text_or_blank(c.getField("body"))).alias("body"),
        ),
    )
    return F.array_max(F.filter(scored, lambda c: c.body != ""))


def best_comments(comments: DataFrame, key: str) -> DataFrame:
    """(key, score, answer) from a table of comments (key, place, body, reactions).

    The same choice for comments that are rows: a maximum with map-side parts,
    so an issue with very many comments is no burden to one task.
    """
    body = text.strip(text.text_or_blank(F.col("body")))
    scored = comments.select(
        key, F.struct(reaction_score(F.col("reactions")).alias("score"), (-F.col("place")).alias("order")).alias("by"), body.alias("body")
    )
    best = scored.filter("body <> ''").groupBy(key).agg(F.max("by").alias("by"), F.max_by("body", "by").alias("answer"))
    return best.select(key, F.col("by.score").alias("score"), "answer")


def issue_pairs(issues: DataFrame, *keys: str) -> DataFrame:
    """Question/answer pairs of issues (title, body, comments_details).

    Issues without title, body or a usable comment are left out.
    """
    has_text = (text.text_or_blank(F.col("title")) != "") & (text.text_or_blank(F.col("body")) != "")
    return (
        issues.filter(has_text)
        .select(
            *keys,
            text.question_text(F.col("title"), F.col("body")).alias("question"),
            best_comment(F.col("comments_details")).getField("body").alias("answer"),
        )
        .filter((F.col("question") != "") & F.col("answer").isNotNull())
    )
