"""Ranking, boosting and formatting of retrieval hits, shared by both retrieval modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerloom import storage
from answerloom.functions import text

BROADCAST_HITS = 500_000
#: Hits that one copy of a document serves.
HITS_PER_COPY = 10_000


def top(hits: DataFrame, depth: int, out: str = "raw_rank") -> DataFrame:
    """Number each query's hits from 1 by falling score, ties by document, and keep ``depth``."""
    best_first = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn(out, F.row_number().over(best_first)).filter(F.col(out) <= depth)


def with_fillers(hits: DataFrame, queries: DataFrame, corpus: DataFrame, depth: int) -> DataFrame:
    """Fill short hit lists up to ``depth`` with zero-score documents, lowest ids first.

    Of the ``depth`` lowest ids at most as many are already hits as the list is
    long, so that pool is always large enough.
    """
    pool = [row.doc_id for row in corpus.select("doc_id").orderBy("doc_id").limit(depth).collect()]
    if not pool:
        return hits
    found = hits.groupBy("qid").agg(F.collect_list("doc_id").alias("found"))
    lists = queries.select("qid").join(found, "qid", "left").withColumn(
        "found", F.coalesce("found", F.array().cast("array<bigint>"))
    )
    spare = F.array_except(F.array(*map(F.lit, pool)).cast("array<bigint>"), "found")
    fillers = lists.select(
        "qid",
        F.size("found").alias("n"),
        F.posexplode(F.slice(spare, 1, F.greatest(F.lit(depth) - F.size("found"), F.lit(0)))),
    ).select(
        "qid",
        F.col("col").alias("doc_id"),
        F.lit(0.0).alias("score"),
        (F.col("n") + F.col("pos") + 1).cast("int").alias("raw_rank"),
    )
    return hits.unionByName(fillers)


def with_attributes(hits: DataFrame, corpus: DataFrame, n_hits: int, broadcast: int = BROADCAST_HITS) -> DataFrame:
    """Fetch the corpus columns of each hit.

    ``n_hits`` is an upper bound on the hits. Up to
    ``broadcast`` of them the hits are broadcast and the corpus is scanned where it lies.
    Beyond it both sides meet by document: only documents that were hit are moved, each as many times as ``HITS_PER_COPY`` hits
    of it ask for, so nearly all just once, and the hits of one that very many queries hit are dealt over its copies.
    """
    if n_hits <= broadcast:
        return corpus.join(F.broadcast(hits), "doc_id")
    counts = hits.groupBy("doc_id").agg(F.floor((F.count("*") - 1) / HITS_PER_COPY).cast("int").alias("more"))
    counts = storage.save(counts, "hit-counts")
    # at most one document in HITS_PER_COPY hits, whatever the corpus
    often = counts.filter("more > 0")
    copy = F.coalesce(F.pmod(F.xxhash64("qid"), F.col("more") + 1).cast("int"), F.lit(0))
    dealt = hits.join(often, "doc_id", "left").withColumn("copy", copy).drop("more")
    wanted = corpus.join(counts, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("more")))).drop("more")
    return dealt.join(wanted, ["doc_id", "copy"]).drop("copy")


def boosted(hits: DataFrame, k: int, boost: float, match: str = "substring") -> DataFrame:
    """Re-rank each query's hits after adding ``boost`` where a keyword occurs in the tags.

    Needs (qid, score, raw_rank, keywords, tags). Only hits already fetched can
    move up. Adds ``boosted`` and a ``rank`` from 0.
    """
    extra = F.when(text.matches_tags(F.col("keywords"), F.col("tags"), match), F.lit(float(boost))).otherwise(0.0)
    by_score = Window.partitionBy("qid").orderBy(F.desc("boosted"), "raw_rank")
    return (
        hits.withColumn("boosted", F.col("score") + extra)
        .withColumn("rank", F.row_number().over(by_score) - 1)
        .filter(F.col("rank") < k)
    )


def contexts(hits: DataFrame) -> DataFrame:
    """One text per query from its hits in rank order: (qid, context).

    A query has at most ``k`` hits, so the collected list is bounded.
    """
    # The layout of one hit and the line break between two.
    block = F.concat(
        F.col("rank").cast("string"),
        F.lit(")\nQuestion: "),
        text.text_or_blank(F.col("title")),
        F.lit("\nTags: "),
        text.shown_tags(F.col("tags")),
        F.lit("\nAnswer: "),
        text.text_or_blank(F.col("answer")),
        F.lit("\n"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(in_order, lambda h: h.block), "\n").alias("context"))
