"""Text-similarity scores and their means."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.operators import metrics
from answerloom.plans import evaluation
from workload import fixtures
from workload import sqltext as S
from workload.registry import query
from workload.stemsql import stems


@query(
    "bleu",
    f"WITH {S.PAIRS}, {S.bleu('question', 'answer', 'pairs')} SELECT qid, round(bleu, 6) AS bleu FROM bleu_scores",
)
def bleu(spark, sf_dir):
    scored = metrics.with_bleu(fixtures.scored_pairs(spark, sf_dir), "prediction", "truth")
    return scored.select("qid", F.round("bleu", 6).alias("bleu"))


@query(
    "rouge1",
    f"WITH {S.PAIRS}, {S.rouge1('question', 'answer', 'pairs')} SELECT qid, round(rouge1, 6) AS rouge1 FROM rouge1_scores",
)
def rouge1(spark, sf_dir):
    scored = metrics.with_rouge(fixtures.scored_pairs(spark, sf_dir), "prediction", "truth", rougel_out=None, stem=False)
    return scored.select("qid", F.round("rouge1", 6).alias("rouge1"))


@query(
    "rougel",
    f"""WITH RECURSIVE {S.PAIRS}, {S.lcs(S.ascii_tokens('question'), S.ascii_tokens('answer'), 'pairs')}
SELECT qid, round(CASE WHEN common > 0 THEN 2.0 * common / (la + lb) ELSE 0.0 END, 6) AS rougel FROM lcs_lengths""",
)
def rougel(spark, sf_dir):
    scored = metrics.with_rouge(fixtures.scored_pairs(spark, sf_dir), "prediction", "truth", rouge1_out=None, stem=False)
    return scored.select("qid", F.round("rougel", 6).alias("rougel"))


STEMMED = f"""tokens AS (
  SELECT qid, side, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM (
    SELECT qid, 'p' AS side, {S.ascii_tokens('question')} AS words FROM pairs UNION ALL SELECT qid, 't', {S.ascii_tokens('answer')} FROM pairs)),
distinct_words AS (SELECT DISTINCT word FROM tokens), {stems('stems', 'distinct_words')},
joined AS (SELECT qid, string_agg(stem, ' ' ORDER BY place) FILTER (side = 'p') AS p, string_agg(stem, ' ' ORDER BY place) FILTER (side = 't') AS t
  FROM tokens JOIN stems USING (word) GROUP BY qid),
stemmed AS (SELECT qid, coalesce(p, '') AS p, coalesce(t, '') AS t FROM pairs LEFT JOIN joined USING (qid))"""


@query(
    "rouge_stem",
    f"""WITH RECURSIVE {S.PAIRS}, {STEMMED}, {S.rouge1('p', 't', 'stemmed')}, {S.lcs(S.ascii_tokens('p'), S.ascii_tokens('t'), 'stemmed')}
SELECT qid, round(rouge1, 6) AS rouge1, round(CASE WHEN common > 0 THEN 2.0 * common / (la + lb) ELSE 0.0 END, 6) AS rougel
FROM rouge1_scores JOIN lcs_lengths USING (qid)""",
)
def rouge_stem(spark, sf_dir):
    scored = metrics.with_rouge(fixtures.scored_pairs(spark, sf_dir), "prediction", "truth")
    return scored.select("qid", F.round("rouge1", 6).alias("rouge1"), F.round("rougel", 6).alias("rougel"))


NEIGHBOURS = """neighbours AS (
  SELECT a.item_id AS qid, a.text AS prediction, b.text AS truth
  FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"""


@query(
    "edit_similarity",
    f"""WITH RECURSIVE {NEIGHBOURS}, {S.lcs("string_split(prediction, '')", "string_split(truth, '')", 'neighbours')}
SELECT qid, round(2.0 * common / (la + lb), 6) AS edit_similarity FROM lcs_lengths""",
)
def edit_similarity(spark, sf_dir):
    items = fixtures.benchmark_queries(spark, sf_dir)
    following = items.select((F.col("qid") - 1).alias("qid"), F.col("text").alias("truth"))
    scored = metrics.with_edit_similarity(
        items.withColumnRenamed("text", "prediction").join(following, "qid"), "prediction", "truth"
    )
    return scored.select("qid", F.round("edit_similarity", 6).alias("edit_similarity"))


@query("pair_scores")
def pair_scores(spark, sf_dir):
    """All four scores of whole conversation texts; too slow to check in SQL."""
    scored = metrics.score_pairs(fixtures.scored_pairs(spark, sf_dir))
    return scored.select("qid", *[F.round(m, 6).alias(m) for m in metrics.METRICS])


@query(
    "metric_means",
    f"""WITH {S.PAIRS}, {S.bleu('question', 'answer', 'pairs')}, {S.rouge1('question', 'answer', 'pairs')}
SELECT round(avg(bleu), 6) AS bleu, round(avg(rouge1), 6) AS rouge1, count(*) AS n
FROM bleu_scores JOIN rouge1_scores USING (qid)""",
)
def metric_means(spark, sf_dir):
    pairs = metrics.with_bleu(fixtures.scored_pairs(spark, sf_dir), "prediction", "truth")
    scored = metrics.with_rouge(pairs, "prediction", "truth", rougel_out=None, stem=False)
    means = metrics.summary(scored, metrics=("bleu", "rouge1"))
    return means.select(F.round("bleu", 6).alias("bleu"), F.round("rouge1", 6).alias("rouge1"), "n")


JUDGED = r"""judged AS (
  SELECT doc_id, quality,
    CASE WHEN doc_id % 7 = 0 THEN 'no score' ELSE 'score \boxed{' || (quality * 0.5 + toxic * 0.25) || '}' END AS text
  FROM labels)"""


@query(
    "judge_parse",
    rf"""WITH {JUDGED} SELECT quality, round(avg(score), 6) AS judge_mean, count(score) AS judge_n, count(*) AS n
FROM (SELECT quality, try_cast(regexp_extract(text, '\\boxed\{{ *([\d.]+) *\}}', 1) AS DOUBLE) AS score FROM judged)
GROUP BY quality""",
)
def judge_parse(spark, sf_dir):
    number = F.col("quality") * 0.5 + F.col("toxic") * 0.25
    boxed = F.concat(F.lit("score \\boxed{"), number.cast("string"), F.lit("}"))
    labels = fixtures.load(spark, sf_dir, "labels")
    marked = labels.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit("no score")).otherwise(boxed))
    means = metrics.summary(evaluation.with_judge_score(marked, "text"), ["quality"], metrics=())
    return means.select("quality", F.round("judge_mean", 6).alias("judge_mean"), "judge_n", "n")
