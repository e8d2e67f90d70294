"""Tokens, indexes, retrieval in both modes, and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom import storage
from answerloom.functions import text
from answerloom.functions.words import ENGLISH_STOP_WORDS
from answerloom.operators import dense, keyword, ranking
from answerloom.plans import retrieval
from workload import fixtures
from workload import sqltext as S
from workload.registry import query

USERS = f"{S.TURNS}, users AS (SELECT qid, text FROM turns WHERE role = 'user')"
BENCH = "bench AS (SELECT item_id AS qid, text FROM benchmark)"
TEXTS = "texts AS (SELECT doc_id, title || ' ' || body AS text FROM corpus)"
HITS = "SELECT qid, rank, doc_id, tags, score, round(boosted, 6) AS boosted, raw_rank FROM hits"

USER_HITS = f"""WITH {USERS}, {S.CORPUS}, {TEXTS}, {S.keyword_scores('users', 'texts', 10)},
{S.reranked('hits', 'kw_raw', 'users')}"""

PADDED_USER_HITS = f"""WITH {USERS}, {S.CORPUS}, {TEXTS}, {S.padded_scores('users', 'texts', 10)},
{S.reranked('hits', 'padded', 'users')}"""

VECTOR_CORPUS = """corpus AS (
  SELECT vec_id AS doc_id, 'vector ' || vec_id AS title, 'group' || label || '|set' || (vec_id % 3) AS tags,
         'label ' || label AS answer FROM embeddings),
queries AS (SELECT vec_id AS qid, 'Which are in group' || label || '?' AS text, embedding FROM embeddings),
docs AS (SELECT vec_id AS doc_id, embedding FROM embeddings)"""

VECTOR_HITS = f"""WITH {VECTOR_CORPUS}, {S.vector_scores('queries', 'docs', 10)},
{S.reranked('hits', 'vec_raw', 'queries')}"""

SEMANTIC_HITS = f"""WITH {USERS}, {S.CORPUS}, {TEXTS}, {S.hash_vectors('dv', 'doc_id', 'texts')},
{S.hash_vectors('qv', 'qid', 'users')}, {S.vector_scores('qv', 'dv', 10)},
{S.reranked('hits', 'vec_raw', 'users')}"""


def shown(hits):
    return hits.select("qid", "rank", "doc_id", "tags", "score", F.round("boosted", 6).alias("boosted"), "raw_rank")


def saved_counts(spark, sf_dir):
    """Term counts of the documents, written as an index build writes them.

    Exploding them straight away would compute them again in the filter that
    the optimizer puts before an explode.
    """
    counted = keyword.term_counts(document_texts(spark, sf_dir), "doc_id", "text", ENGLISH_STOP_WORDS)
    return storage.save(counted, "term-counts")


def document_texts(spark, sf_dir):
    return fixtures.documents(spark, sf_dir).select("doc_id", "text")


@query(
    "tfidf_tokens",
    f"""SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df
FROM (SELECT doc_id, unnest({S.word_tokens('text')}) AS term FROM documents) GROUP BY term""",
)
def tfidf_tokens(spark, sf_dir):
    terms = saved_counts(spark, sf_dir).select(F.inline("counts"))
    return terms.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df"))


@query(
    "keywords",
    f"""SELECT qid, array_to_string({S.keywords('text')}, ' ') AS keywords FROM (
  SELECT 'turn' || (conv_id * 100 + turn) AS qid, text FROM conversations
  UNION ALL SELECT 'item' || item_id, text FROM benchmark)""",
)
def keywords(spark, sf_dir):
    turns = fixtures.turns(spark, sf_dir).select(F.concat(F.lit("turn"), "qid").alias("qid"), "text")
    items = fixtures.benchmark_queries(spark, sf_dir).select(F.concat(F.lit("item"), "qid").alias("qid"), "text")
    return turns.unionByName(items).select(
        "qid", F.array_join(text.keywords(F.col("text")), " ").alias("keywords")
    )


@query(
    "idf_stats",
    f"WITH {S.weights('d', 'doc_id', 'documents')} SELECT term, df, round(idf, 6) AS idf FROM d_idf",
)
def idf_stats(spark, sf_dir):
    counted = saved_counts(spark, sf_dir)
    terms = keyword.with_idf(keyword.term_frequency(counted), counted.count())
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "doc_norms",
    f"""WITH {S.weights('d', 'doc_id', 'documents')}
SELECT doc_id, count(*) AS n_terms, round(sqrt(sum(w * w)), 6) AS length FROM d_raw GROUP BY doc_id""",
)
def doc_norms(spark, sf_dir):
    index = keyword.build(document_texts(spark, sf_dir))
    return index.documents.select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.round("length", 6).alias("length"))


@query(
    "keyword_topk_plain",
    f"""WITH {BENCH}, {S.keyword_scores('bench', 'documents', 5)}
SELECT qid, raw_rank - 1 AS rank, doc_id, score FROM kw_raw""",
)
def keyword_topk_plain(spark, sf_dir):
    index = keyword.build(document_texts(spark, sf_dir))
    hits = keyword.nearest(fixtures.benchmark_queries(spark, sf_dir), index, 5)
    return hits.select("qid", (F.col("raw_rank") - 1).alias("rank"), "doc_id", "score")


@query(
    "keyword_index_segments",
    f"""WITH {BENCH}, {S.keyword_scores('bench', 'documents', 5)}
SELECT qid, raw_rank - 1 AS rank, doc_id, score FROM kw_raw""",
)
def keyword_index_segments(spark, sf_dir):
    """A stored index, built of some sources, added to, opened again and searched."""
    place, documents = storage.new_location(spark, "keyword-index"), fixtures.documents(spark, sf_dir)
    first = F.coalesce(F.xxhash64("source") % 2 == 0, F.lit(False))
    keyword.build(documents.filter(first).select("doc_id", "text"), location=place)
    keyword.add(documents.filter(~first).select("doc_id", "text"), place)
    hits = keyword.nearest(fixtures.benchmark_queries(spark, sf_dir), keyword.open_index(spark, place), 5)
    return hits.select("qid", (F.col("raw_rank") - 1).alias("rank"), "doc_id", "score")


def user_hits(spark, sf_dir, **options):
    corpus, queries = fixtures.corpus(spark, sf_dir), fixtures.user_queries(spark, sf_dir)
    return retrieval.keyword_hits(queries, corpus, **options)


@query("keyword_topk_boost", f"{USER_HITS} {HITS}")
def keyword_topk_boost(spark, sf_dir):
    return shown(user_hits(spark, sf_dir, pad_zero=False))


@query(
    "keyword_topk_exact_tag",
    f"""WITH {USERS}, {S.CORPUS}, {TEXTS}, {S.keyword_scores('users', 'texts', 10)},
{S.reranked('hits', 'kw_raw', 'users').replace("contains(lower(c.tags), w)", "list_contains(string_split(lower(c.tags), '|'), w)")}
{HITS}""",
)
def keyword_topk_exact_tag(spark, sf_dir):
    return shown(user_hits(spark, sf_dir, pad_zero=False, options=retrieval.RetrievalOptions(match="tag")))


@query("keyword_topk_many_hits", f"{USER_HITS} {HITS}")
def keyword_topk_many_hits(spark, sf_dir):
    """The same with hits that are too many to broadcast."""
    return shown(user_hits(spark, sf_dir, pad_zero=False, options=retrieval.RetrievalOptions(broadcast_hits=0)))


# The test items as corpus: they are few and short, so that many lists need filling.
ITEMS = """corpus AS (
  SELECT item_id AS doc_id, 'item ' || item_id AS title, text AS body, 'set' || (item_id % 3) AS tags, text AS answer
  FROM benchmark)"""


@query(
    "keyword_topk_padded",
    f"""WITH {USERS}, {ITEMS}, {TEXTS}, {S.padded_scores('users', 'texts', 10)},
{S.reranked('hits', 'padded', 'users')} {HITS}""",
)
def keyword_topk_padded(spark, sf_dir):
    return shown(retrieval.keyword_hits(fixtures.user_queries(spark, sf_dir), items(spark, sf_dir)))


def items(spark, sf_dir):
    return fixtures.benchmark_queries(spark, sf_dir).select(
        F.col("qid").alias("doc_id"),
        F.concat(F.lit("item "), "qid").alias("title"),
        F.col("text").alias("body"),
        F.concat(F.lit("set"), F.col("qid") % 3).alias("tags"),
        F.col("text").alias("answer"),
    )


@query(
    "keyword_topk_short",
    f"""WITH {USERS}, {ITEMS}, {TEXTS}, {S.keyword_scores('users', 'texts', 10)},
{S.reranked('hits', 'kw_raw', 'users')} {HITS}""",
)
def keyword_topk_short(spark, sf_dir):
    """The same without filling: many lists stay short."""
    return shown(retrieval.keyword_hits(fixtures.user_queries(spark, sf_dir), items(spark, sf_dir), pad_zero=False))


@query("keyword_context", f"{PADDED_USER_HITS}, {S.contexts('found', 'hits', 'users')} SELECT * FROM found")
def keyword_context(spark, sf_dir):
    return retrieval.contexts(user_hits(spark, sf_dir), fixtures.user_queries(spark, sf_dir))


@query(
    "vector_normalize",
    """SELECT vec_id, place, round(v[place + 1], 6) AS value FROM (
  SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))) AS v, unnest(range(len(w))) AS place
  FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 2)) AS w FROM embeddings))""",
)
def vector_normalize(spark, sf_dir):
    scaled = fixtures.load(spark, sf_dir, "embeddings").withColumn(
        "embedding", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2))
    )
    unit = dense.normalised(scaled).select("vec_id", F.posexplode("embedding").alias("place", "value"))
    return unit.select("vec_id", F.col("place").cast("bigint").alias("place"), F.round("value", 6).alias("value"))


def vector_tables(spark, sf_dir):
    vectors = fixtures.spread(fixtures.load(spark, sf_dir, "embeddings"))
    queries = vectors.select(
        F.col("vec_id").alias("qid"),
        F.concat(F.lit("Which are in group"), "label", F.lit("?")).alias("text"),
        "embedding",
    )
    corpus = vectors.select(
        F.col("vec_id").alias("doc_id"),
        F.concat(F.lit("vector "), "vec_id").alias("title"),
        F.concat(F.lit("group"), "label", F.lit("|set"), F.col("vec_id") % 3).alias("tags"),
        F.concat(F.lit("label "), "label").alias("answer"),
    )
    return queries, corpus, vectors.select(F.col("vec_id").alias("doc_id"), "embedding")


@query(
    "vector_topk",
    f"WITH {VECTOR_CORPUS}, {S.vector_scores('queries', 'docs', 10)} SELECT qid, doc_id, score, raw_rank FROM vec_raw",
)
def vector_topk(spark, sf_dir):
    queries, _, documents = vector_tables(spark, sf_dir)
    return dense.nearest(queries, documents, 10)


@query(
    "vector_topk_blocked",
    f"WITH {VECTOR_CORPUS}, {S.vector_scores('queries', 'docs', 10)} SELECT qid, doc_id, score, raw_rank FROM vec_raw",
)
def vector_topk_blocked(spark, sf_dir):
    """The same with a query set that is too large for one block."""
    queries, _, documents = vector_tables(spark, sf_dir)
    return dense.nearest(queries, documents, 10, block_numbers=16_000)


@query(
    "vector_topk_clustered",
    f"WITH {VECTOR_CORPUS}, {S.vector_scores('queries', 'docs', 10)} SELECT qid, doc_id, score, raw_rank FROM vec_raw",
)
def vector_topk_clustered(spark, sf_dir):
    """The same over vectors written by cluster, reading only those that can hold hits."""
    queries, _, documents = vector_tables(spark, sf_dir)
    return dense.nearest_in_clusters(queries, dense.clustered(documents), 10)


@query("vector_topk_boost", f"{VECTOR_HITS} {HITS}")
def vector_topk_boost(spark, sf_dir):
    queries, corpus, documents = vector_tables(spark, sf_dir)
    return shown(retrieval.vector_hits(queries, corpus, queries, documents))


@query("vector_context", f"{VECTOR_HITS}, {S.contexts('found', 'hits', 'queries')} SELECT * FROM found")
def vector_context(spark, sf_dir):
    queries, corpus, documents = vector_tables(spark, sf_dir)
    return retrieval.contexts(retrieval.vector_hits(queries, corpus, queries, documents), queries)


def hash_encoded(df, key):
    """Text vectors by token hashing, standing in for a sentence encoder."""
    tokens = df.select(key, text.word_tokens(F.col("text"), ENGLISH_STOP_WORDS).alias("tokens"))
    return dense.hash_vectors(tokens, F.col("tokens"), key)


@query(
    "hash_encode",
    f"""WITH {BENCH}, {S.hash_vectors('v', 'qid', 'bench')}
SELECT qid, bucket, round(embedding[bucket + 1], 6) AS value
FROM v CROSS JOIN (SELECT unnest(range(64)) AS bucket)""",
)
def hash_encode(spark, sf_dir):
    encoded = hash_encoded(fixtures.benchmark_queries(spark, sf_dir), "qid")
    return encoded.select("qid", F.posexplode("embedding").alias("bucket", "value")).select(
        "qid", F.col("bucket").cast("bigint").alias("bucket"), F.round("value", 6).alias("value")
    )


def semantic_hits(spark, sf_dir):
    corpus, queries = fixtures.corpus(spark, sf_dir), fixtures.user_queries(spark, sf_dir)
    vectors = dense.build(retrieval.corpus_texts(corpus), hash_encoded)
    return retrieval.vector_hits(queries, corpus, hash_encoded(queries, "qid"), vectors)


@query("semantic_topk_boost", f"{SEMANTIC_HITS} {HITS}")
def semantic_topk_boost(spark, sf_dir):
    return shown(semantic_hits(spark, sf_dir))


@query("semantic_context", f"{SEMANTIC_HITS}, {S.contexts('found', 'hits', 'users')} SELECT * FROM found")
def semantic_context(spark, sf_dir):
    return retrieval.contexts(semantic_hits(spark, sf_dir), fixtures.user_queries(spark, sf_dir))
