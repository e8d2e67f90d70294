"""Scans, filters, sampling and the building of question/answer tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom import storage
from answerloom.functions import text
from answerloom.operators import answers, metrics, sampling
from answerloom.plans import datasets
from answerloom.sources import issues, tables
from workload import fixtures
from workload import sqltext as S
from workload.registry import query

ISSUE_PAIRS_SQL = f"""WITH {S.PAIRS}, lines AS (
  SELECT qid, unnest(string_split(answer, chr(10))) AS line,
         generate_subscripts(string_split(answer, chr(10)), 1) - 1 AS place FROM pairs),
best AS (
  SELECT qid, {S.strip('line')} AS answer FROM lines WHERE {S.strip('line')} <> ''
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY length(line) % 4 + place % 2 DESC, place) = 1)
SELECT {S.strip('question')} AS question, b.answer
FROM pairs JOIN best b USING (qid) WHERE {S.first_line('question')} <> '' AND {S.other_lines('question')} <> ''"""


@query(
    "corpus_text",
    f"WITH {S.CORPUS} SELECT doc_id, title || ' ' || body AS text, replace(tags, '|', ', ') AS tags FROM corpus",
)
def corpus_text(spark, sf_dir):
    corpus = fixtures.corpus(spark, sf_dir)
    return corpus.select(
        "doc_id",
        text.corpus_text(F.col("title"), F.col("body")).alias("text"),
        text.shown_tags(F.col("tags")).alias("tags"),
    )


@query(
    "qa_join_filter",
    """SELECT o_orderkey AS question_id, o_orderstatus AS question_title,
  CAST(o_custkey AS VARCHAR) AS question_body, o_orderpriority AS question_tags,
  l_linenumber AS answer_id, l_returnflag AS answer_body, CAST(l_quantity AS INTEGER) AS answer_score
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice >= 100000 AND l_quantity >= 5
  AND (o_orderpriority LIKE '%HIGH%' OR o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%LOW%')
ORDER BY ALL LIMIT 20000""",
)
def qa_join_filter(spark, sf_dir):
    questions = fixtures.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("title"),
        F.col("o_custkey").cast("string").alias("body"),
        F.col("o_orderpriority").alias("tags"),
        F.col("o_totalprice").alias("score"),
        F.col("o_orderdate").alias("creation_date"),
    )
    lines = fixtures.load(spark, sf_dir, "lineitem").filter("l_quantity >= 5").select(
        F.col("l_linenumber").alias("id"),
        F.col("l_orderkey").alias("parent_id"),
        F.col("l_returnflag").alias("body"),
        F.col("l_quantity").cast("int").alias("score"),
    )
    return datasets.qa_from_posts(
        questions.filter("score >= 100000"),
        lines,
        since="1998-01-01",
        min_question_score=None,
        min_answer_score=5,
        tags=("HIGH", "URGENT", "LOW"),
        limit=20000,
    )


@query(
    "qa_pairs_posts",
    f"""WITH {S.PAIRS} SELECT qid AS question_id, {S.first_line('question')} AS question_title,
  {S.other_lines('question')} AS question_body, 'user' AS question_tags, qid + 1 AS answer_id,
  answer AS answer_body, CAST(length(answer) AS INTEGER) AS answer_score FROM pairs""",
)
def qa_pairs_posts(spark, sf_dir):
    turns = fixtures.turns(spark, sf_dir)
    questions = turns.filter("role = 'user'").select(
        F.col("qid").alias("id"),
        fixtures.first_line(F.col("text")).alias("title"),
        fixtures.other_lines(F.col("text")).alias("body"),
        F.col("role").alias("tags"),
    )
    replies = turns.filter("role = 'assistant'").select(
        F.col("qid").alias("id"),
        (F.col("qid") - 1).alias("parent_id"),
        F.col("text").alias("body"),
        F.length("text").alias("score"),
    )
    return datasets.qa_from_posts(questions, replies, None, None, None, None)


@query("head_limit", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 800")
def head_limit(spark, sf_dir):
    return sampling.first_rows(fixtures.load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), 800, "doc_id")


@query(
    "stratified_sample",
    """SELECT doc_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id)
  <= greatest(1, floor(count(*) OVER (PARTITION BY source) * 0.1))""",
)
def stratified_sample(spark, sf_dir):
    documents = fixtures.load(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.stratified_sample(documents, "source", "doc_id", 0.1, 42)


@query(
    "json_events",
    """SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total
FROM events GROUP BY event_type""",
)
def json_events(spark, sf_dir):
    props = F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))
    return (
        fixtures.load(spark, sf_dir, "events")
        .select("event_type", props.alias("p"))
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total"))
    )


@query(
    "best_comment",
    f"""WITH {S.TURNS} SELECT conv_id, CAST(length(text) % 4 + turn % 2 AS INTEGER) AS score, {S.strip('text')} AS answer
FROM turns WHERE {S.strip('text')} <> ''
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 4 + turn % 2 DESC, turn) = 1""",
)
def best_comment(spark, sf_dir):
    """The best turn of every conversation, with the turns as rows."""
    comments = fixtures.turns(spark, sf_dir).select(
        "conv_id",
        F.col("turn").alias("place"),
        F.col("text").alias("body"),
        fixtures.reactions(F.length("text"), F.col("turn")).alias("reactions"),
    )
    return answers.best_comments(comments, "conv_id")


@query("issue_pairs", ISSUE_PAIRS_SQL)
def issue_pairs(spark, sf_dir):
    return answers.issue_pairs(fixtures.issues(spark, sf_dir))


# A file for each row; tasks put their own files in place, where the driver would move all of them one by one.
FILES = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}


@query("issue_tree", ISSUE_PAIRS_SQL)
def issue_tree(spark, sf_dir):
    """Write every issue as a JSON file of its own, then build the pairs from the tree."""
    root = storage.new_location(spark, "issue-tree")
    issues = fixtures.issues(spark, sf_dir).withColumn("repo", F.pmod("qid", F.lit(10)))
    issues.drop("qid").write.options(**FILES).partitionBy("repo").json(root)
    return datasets.qa_from_issues(spark, root, ratio=1.0)


@query(
    "issue_tree_sample",
    f"""WITH {S.PAIRS}, files AS (
  SELECT qid % 7 AS repo, CASE WHEN qid % 7 = 3 AND qid % 2 = 0 THEN 1 ELSE 0 END AS sub, length(answer) % 5 = 0 AS bad FROM pairs),
counted AS (SELECT repo, sub, count(*) AS n, count(*) FILTER (bad) AS malformed FROM files GROUP BY ALL)
SELECT CAST(repo AS INTEGER) AS repo, n AS listed, CAST(greatest(1, floor(n * 0.3)) AS BIGINT) AS sampled, malformed
FROM counted c WHERE NOT EXISTS (SELECT 1 FROM counted d WHERE d.repo = c.repo AND d.sub > c.sub)""",
)
def issue_tree_sample(spark, sf_dir):
    """A tree with files that cannot be parsed and a folder that has files beside a folder with files: those beside it do not count."""
    root = storage.new_location(spark, "issue-tree")
    made = fixtures.issues(spark, sf_dir).join(fixtures.pairs(spark, sf_dir).select("qid", F.length("answer").alias("size")), "qid")
    made = storage.save(made.withColumn("repo", F.col("qid") % 7).withColumn("below", (F.col("repo") == 3) & (F.col("qid") % 2 == 0)), "issues")
    for bad in (False, True):
        details = F.lit("none") if bad else F.col("comments_details")
        rows = made.filter((F.col("size") % 5 == 0) == bad).withColumn("comments_details", details).drop("size", "qid")
        for below in (False, True):
            names = ("repo", "sub") if below else ("repo",)
            part = rows.filter(F.col("below") == below).withColumn("sub", F.lit(1)) if below else rows.filter("not below")
            part.drop("below").write.mode("append").options(**FILES).partitionBy(*names).json(root)
    listed = issues.list_files(spark, root)
    repo = F.regexp_extract("path", "repo=([0-9]+)", 1).cast("int").alias("repo")
    parsed = issues.read_issues(listed).groupBy(repo).agg(F.count("*").alias("listed"), F.count_if("malformed").alias("malformed"))
    sampled = issues.read_issues(issues.sample_files(listed, 0.3)).groupBy(repo).agg(F.count("*").alias("sampled"))
    return parsed.join(sampled, "repo").select("repo", "listed", "sampled", "malformed")


QA_POSTS = f"""WITH {S.PAIRS} SELECT qid AS question_id, {S.first_line('question')} AS question_title,
  {S.other_lines('question')} AS question_body, 'user' AS question_tags, qid + 1 AS answer_id,
  answer AS answer_body, CAST(length(answer) AS INTEGER) AS answer_score FROM pairs"""


# An empty field of a CSV file is a missing text.
@query("corpus_files", f"SELECT * REPLACE (nullif(question_body, '') AS question_body), 'csv' AS kind FROM ({QA_POSTS}) UNION ALL SELECT *, 'parquet' FROM ({QA_POSTS} ORDER BY question_id, answer_id LIMIT 50)")
def corpus_files(spark, sf_dir):
    """The corpus written and read back as CSV, whole, and as Parquet, its first rows."""
    place, corpus = storage.new_location(spark, "corpus"), qa_pairs_posts(spark, sf_dir)
    tables.write_csv(corpus, f"{place}/corpus.csv")
    corpus.write.parquet(f"{place}/corpus")
    whole = tables.read_corpus(spark, f"{place}/corpus.csv").withColumn("kind", F.lit("csv"))
    return whole.unionByName(tables.read_corpus(spark, f"{place}/corpus", limit=50).withColumn("kind", F.lit("parquet")))


@query(
    "posts_tables",
    """SELECT o_orderkey AS question_id, o_orderstatus AS question_title, o_orderpriority AS question_body, o_orderpriority AS question_tags,
  l_orderkey * 10 + l_linenumber AS answer_id, l_returnflag AS answer_body, CAST(l_quantity AS INTEGER) AS answer_score
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_custkey % 11 >= 5 AND CAST(l_quantity AS INTEGER) >= 5
  AND (o_orderpriority LIKE '%HIGH%' OR o_orderpriority LIKE '%LOW%')""",
)
def posts_tables(spark, sf_dir):
    """Question and answer posts written as tables, read by their schemas and joined."""
    place = storage.new_location(spark, "posts")
    fixtures.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("id"),
        F.col("o_orderstatus").alias("title"),
        F.col("o_orderpriority").alias("body"),
        F.col("o_orderpriority").alias("tags"),
        (F.col("o_custkey") % 11).cast("int").alias("score"),
        F.col("o_orderdate").cast("timestamp").alias("creation_date"),
    ).write.parquet(f"{place}/questions")
    fixtures.load(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"),
        F.col("l_orderkey").cast("long").alias("parent_id"),
        F.col("l_returnflag").alias("body"),
        F.col("l_quantity").cast("int").alias("score"),
    ).write.parquet(f"{place}/answers")
    return datasets.qa_from_posts(*tables.read_posts(spark, f"{place}/questions", f"{place}/answers"), since="1997-06-01", tags=("HIGH", "LOW"))


@query(
    "braces",
    """SELECT event_id, replace(replace(props, '{', 'left curly brace'), '}', 'right curly brace') AS spelled,
  replace(replace(props, '{', '{{'), '}', '}}') AS doubled FROM events""",
)
def braces(spark, sf_dir):
    props = F.col("props")
    return fixtures.load(spark, sf_dir, "events").select("event_id", text.spell_out_braces(props).alias("spelled"), text.double_braces(props).alias("doubled"))


@query("csv_round_trip", f"WITH {S.PAIRS} SELECT question, answer FROM pairs")
def csv_round_trip(spark, sf_dir):
    path = storage.new_location(spark, "eval-csv")
    tables.write_csv(fixtures.pairs(spark, sf_dir).select("question", "answer"), path)
    return tables.read_eval_csv(spark, path).select("question", "answer")


@query("csv_columns_by_name", f"WITH {S.PAIRS} SELECT question, answer FROM pairs")
def csv_columns_by_name(spark, sf_dir):
    """The header names the columns: they come in another order, with one that is not asked for."""
    path = storage.new_location(spark, "eval-csv")
    pairs = fixtures.pairs(spark, sf_dir)
    tables.write_csv(pairs.select("answer", F.col("qid").alias("note"), "question"), path)
    return tables.read_eval_csv(spark, path).select("question", "answer")


@query(
    "pair_integrity",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id,
  CASE WHEN d.doc_id IS NULL THEN 'prediction' WHEN l.doc_id IS NULL THEN 'truth' END AS missing
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id
WHERE d.doc_id IS NULL OR l.doc_id IS NULL""",
)
def pair_integrity(spark, sf_dir):
    documents = fixtures.load(spark, sf_dir, "documents").select("doc_id")
    labels = fixtures.load(spark, sf_dir, "labels").select("doc_id")
    return metrics.paired(documents, labels, "doc_id", report=True).filter("missing is not null")
