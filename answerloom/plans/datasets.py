"""Building question/answer tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from answerloom.operators import answers as answering
from answerloom.operators.sampling import first_rows
from answerloom.sources import issues, tables

# The selection of the published corpus.
SINCE = "2020-01-01"
MIN_SCORE = 5
TAGS = ("python", "javascript", "java")


def any_tag(tags: Column, wanted: Sequence[str]) -> Column:
    return reduce(Column.__or__, (F.contains(tags, F.lit(tag)) for tag in wanted))


def qa_from_posts(
    questions: DataFrame,
    answers: DataFrame,
    since: str | None = SINCE,
    min_question_score: int | None = MIN_SCORE,
    min_answer_score: int | None = MIN_SCORE,
    tags: Sequence[str] | None = TAGS,
    limit: int | None = None,
) -> DataFrame:
    """Join answer posts to their question and keep recent, well-rated ones on the wanted tags.

    A limit takes the first rows by question and answer id; their texts are not moved for it.
    """
    q, a = questions.alias("q"), answers.alias("a")
    joined = q.join(a, F.col("q.id") == F.col("a.parent_id"))
    if since is not None:
        joined = joined.filter(F.col("q.creation_date") >= F.lit(since).cast("timestamp"))
    if min_question_score is not None:
        joined = joined.filter(F.col("q.score") >= min_question_score)
    if min_answer_score is not None:
        joined = joined.filter(F.col("a.score") >= min_answer_score)
    if tags:
        joined = joined.filter(any_tag(F.col("q.tags"), tags))
    selected = joined.select(
        F.col("q.id").alias("question_id"),
        F.col("q.title").alias("question_title"),
        F.col("q.body").alias("question_body"),
        F.col("q.tags").alias("question_tags"),
        F.col("a.id").alias("answer_id"),
        F.col("a.body").alias("answer_body"),
        F.col("a.score").alias("answer_score"),
    )
    return first_rows(selected, limit, "question_id", "answer_id")


def qa_from_issues(
    spark: SparkSession,
    root: str,
    ratio: float = 0.1,
    seed: int = 42,
    leaf_only: bool = True,
    limit: int | None = None,
    output: str | None = None,
    progress: Observation | None = None,
) -> DataFrame:
    """Sample the issue files below ``root`` and pair each issue with its best comment.

    Files are drawn per folder before any is opened. Unreadable files are skipped.
    With ``output`` the pairs are also written there as CSV. ``progress`` observes
    the number of files read and of those skipped, without another pass.
    """
    chosen = issues.sample_files(issues.list_files(spark, root, leaf_only), ratio, seed)
    parsed = issues.read_issues(chosen)
    if progress is not None:
        parsed = parsed.observe(
            progress, F.count(F.lit(1)).alias("files"), F.count_if("malformed").alias("skipped")
        )
    readable = parsed.filter(~F.col("malformed"))
    pairs = first_rows(answering.issue_pairs(readable, "path"), limit, "path").select("question", "answer")
    if output:
        tables.write_csv(pairs, output)
    return pairs
