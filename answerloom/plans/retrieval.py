"""Retrieval of question/answer pairs for a table of queries.

A corpus has (doc_id, title, body, tags, answer), where hits need no body; queries have (qid, text).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom import storage
from answerloom.functions import text
from answerloom.operators import dense, keyword, ranking


@dataclass(frozen=True)
class RetrievalOptions:
    k: int = 5
    overfetch: int = 2
    boost: float = 5.0
    match: str = "substring"
    digits: int = 6
    broadcast_hits: int = ranking.BROADCAST_HITS

    @property
    def depth(self) -> int:
        return self.k * self.overfetch


def corpus_of_posts(qa: DataFrame) -> DataFrame:
    """The retrieval corpus of a question/answer table; the answer id is the key."""
    return qa.select(
        F.col("answer_id").alias("doc_id"),
        F.col("question_title").alias("title"),
        F.col("question_body").alias("body"),
        F.col("question_tags").alias("tags"),
        F.col("answer_body").alias("answer"),
    )


def corpus_texts(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", text.corpus_text(F.col("title"), F.col("body")).alias("text"))


def keyword_hits(
    queries: DataFrame,
    corpus: DataFrame,
    index: keyword.KeywordIndex | None = None,
    options: RetrievalOptions = RetrievalOptions(),
    pad_zero: bool = True,
) -> DataFrame:
    """The ``k`` best documents per query by TF-IDF, after the tag boost.

    ``pad_zero`` fills short lists with documents that share no term, which the
    boost can still move up.
    """
    index = index or keyword.build(corpus_texts(corpus))
    hits = keyword.nearest(queries, index, options.depth, options.digits)
    if pad_zero:
        hits = ranking.with_fillers(storage.save(hits, "found"), queries, corpus, options.depth)
    return _reranked(hits, queries, corpus, options)


def vector_hits(
    queries: DataFrame,
    corpus: DataFrame,
    query_vectors: DataFrame,
    corpus_vectors: DataFrame,
    options: RetrievalOptions = RetrievalOptions(),
) -> DataFrame:
    """The ``k`` best documents per query by vector similarity, after the tag boost."""
    hits = dense.nearest(query_vectors, corpus_vectors, options.depth, options.digits)
    return _reranked(hits, queries, corpus, options)


def _reranked(hits: DataFrame, queries: DataFrame, corpus: DataFrame, options: RetrievalOptions) -> DataFrame:
    """Tags are fetched for all hits, texts only for those that stay."""
    hits = storage.save(hits.select("qid", "doc_id", "score", "raw_rank"), "hits")
    n_hits = hits.count()
    words = queries.select("qid", text.keywords(F.col("text")).alias("keywords"))
    tagged = ranking.with_attributes(hits, corpus.select("doc_id", "tags"), n_hits, options.broadcast_hits).join(words, "qid")
    best = ranking.boosted(tagged, options.k, options.boost, options.match)
    best = storage.save(best.select("qid", "rank", "doc_id", "tags", "score", "boosted", "raw_rank"), "best-hits")
    body = F.col("body") if "body" in corpus.columns else F.lit(None).cast("string").alias("body")
    texts = corpus.select("doc_id", "title", body, "answer")
    return ranking.with_attributes(best, texts, n_hits, options.broadcast_hits).select(
        "qid", "rank", "doc_id", "title", "body", "tags", "answer", "score", "boosted", "raw_rank"
    )


def contexts(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, context) for every query; a query without hits gets a blank context."""
    found = ranking.contexts(hits)
    return queries.select("qid").join(found, "qid", "left").select(
        "qid", text.text_or_blank(F.col("context")).alias("context")
    )
