"""Text-similarity scores of prediction/truth pairs, and their means.

All four scores are computed inside the row, so scoring a table of any size
needs no shuffle; only the means do, with map-side sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions import text
from answerloom.functions.binding import let
from answerloom.functions.similarity import lcs_of_arrays, lcs_of_texts, shared_runs, stemmed, stemmed_sides

METRICS = ("bleu", "rouge1", "rougel", "edit_similarity")
BLEU_ORDER = 4
# Fixed value: numerator that stands for no match of an n-gram length.
BLEU_SMOOTHING = 0.1
shared_words, shared_grams = shared_runs(1), shared_runs(BLEU_ORDER)


class UnmatchedPairs(ValueError):
    """Predictions and truths do not have the same keys."""


def paired(predictions: DataFrame, truths: DataFrame, key: str = "qid", report: bool = False) -> DataFrame:
    """Join predictions and truths one to one.

    Raises when a key does not occur just once on each side; with ``report`` returns the full
    outer join with a ``missing`` column instead.
    """
    if not report:
        sides = predictions.select(key, F.lit(1).alias("__p"), F.lit(0).alias("__t")).union(truths.select(key, F.lit(0), F.lit(1)))
        wrong = sides.groupBy(key).agg(F.sum("__p").alias("__p"), F.sum("__t").alias("__t")).filter("__p <> 1 or __t <> 1").count()
        if wrong:
            raise UnmatchedPairs(f"{wrong} keys do not occur once on either side")
        return predictions.join(truths, key)
    joined = predictions.withColumn("__p", F.lit(True)).join(
        truths.withColumn("__t", F.lit(True)), key, "full_outer"
    )
    missing = F.when(F.col("__p").isNull(), "prediction").when(F.col("__t").isNull(), "truth")
    return joined.withColumn("missing", missing).drop("__p", "__t")


def _f_measure(shared: Column, left: Column, right: Column) -> Column:
    return F.when(shared > 0, 2.0 * shared / (left + right)).otherwise(F.lit(0.0))


def bleu(pred: Column, truth: Column) -> Column:
    """Sentence BLEU of up to four tokens against one reference."""

    def score(runs: Column) -> Column:
        length, reference, log_mean = runs["left"], runs["right"], F.lit(0.0)
        for n in range(1, BLEU_ORDER + 1):
            matches = runs["shared"][n - 1].cast("double")
            possible = F.greatest(F.lit(1), length - (n - 1))
            log_mean = log_mean + F.log(F.greatest(matches, F.lit(BLEU_SMOOTHING)) / possible) / BLEU_ORDER
        brevity = F.when(length > reference, 1.0).otherwise(F.exp(1.0 - reference / length))
        return F.when(runs["shared"][0] > 0, brevity * F.exp(log_mean)).otherwise(0.0)

    def tokens(column: Column) -> Column:
        return text.space_tokens(text.text_or_blank(column))

    return let(shared_grams(tokens(pred), tokens(truth)), score)


def rouge1(pred_tokens: Column, truth_tokens: Column) -> Column:
    """F-measure of the common words of two token arrays."""
    return let(shared_words(pred_tokens, truth_tokens), lambda words: _f_measure(words["shared"][0], words["left"], words["right"]))


def with_bleu(df: DataFrame, pred: str, truth: str, out: str = "bleu") -> DataFrame:
    return df.withColumn(out, bleu(F.col(pred), F.col(truth)))


def with_rouge(
    df: DataFrame,
    pred: str,
    truth: str,
    rouge1_out: str | None = "rouge1",
    rougel_out: str | None = "rougel",
    stem: bool = True,
) -> DataFrame:
    """F-measure of common words (ROUGE-1) and of the longest common subsequence (ROUGE-L)."""
    sides = [text.ascii_tokens(text.text_or_blank(F.col(column))) for column in (pred, truth)]
    if stem and rougel_out:
        df = df.withColumn("__rouge", stemmed_sides(*sides))
        sides, common = [F.col("__rouge.left"), F.col("__rouge.right")], F.col("__rouge.common")
        words = _f_measure(F.col("__rouge.words"), *map(F.size, sides))
    else:
        for name, side in zip(("__rouge_p", "__rouge_t"), sides):
            df = df.withColumn(name, stemmed(side) if stem else side)
        sides = [F.col("__rouge_p"), F.col("__rouge_t")]
        common, words = lcs_of_arrays(*sides), rouge1(*sides)
    if rougel_out:
        df = df.withColumn("__rouge_lcs", common)
        df = df.withColumn(rougel_out, _f_measure(F.col("__rouge_lcs"), *map(F.size, sides))).drop("__rouge_lcs")
    if rouge1_out:
        df = df.withColumn(rouge1_out, words)
    return df.drop("__rouge", "__rouge_p", "__rouge_t")


def with_edit_similarity(df: DataFrame, pred: str, truth: str, out: str = "edit_similarity") -> DataFrame:
    """Insert/delete similarity of the characters; two empty texts are alike."""
    p, t = text.text_or_blank(F.col(pred)), text.text_or_blank(F.col(truth))
    total = F.char_length(p) + F.char_length(t)
    df = df.withColumn("__edit_lcs", lcs_of_texts(p, t))
    return df.withColumn(out, F.when(total > 0, 2.0 * F.col("__edit_lcs") / total).otherwise(1.0)).drop("__edit_lcs")


def score_pairs(df: DataFrame, pred: str = "prediction", truth: str = "truth", stem: bool = True) -> DataFrame:
    """Add bleu, rouge1, rougel and edit_similarity to a table of pairs."""
    return with_edit_similarity(with_rouge(with_bleu(df, pred, truth), pred, truth, stem=stem), pred, truth)


def score_alike(df: DataFrame, key: str = "qid", pred: str = "prediction", truth: str = "truth", stem: bool = True) -> DataFrame:
    """``score_pairs`` for a table where several rows of a key may have the same two texts: these are scored once, at the price of a shuffle.

    The number of tasks is given, as few bytes are much work here and would be dealt to few tasks.
    """
    session, others = df.sparkSession, [c for c in df.columns if c not in (key, pred, truth)]
    tasks = max(2 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    alike = df.repartition(tasks, key, pred, truth).groupBy(key, pred, truth).agg(F.collect_list(F.struct(*others)).alias("__rows"))
    scored = score_pairs(alike, pred, truth, stem)
    return scored.select(key, pred, truth, *METRICS, F.inline("__rows"))


def summary(scored: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean of each metric and the number of rows, per group; NULL means when there are none.

    With a ``judge_score`` column also its mean and count over the rows that have one.
    """
    parts = [F.avg(m).alias(m) for m in metrics]
    if "judge_score" in scored.columns:
        parts += [F.avg("judge_score").alias("judge_mean"), F.count("judge_score").alias("judge_n")]
    return scored.groupBy(*by).agg(*parts, F.count(F.lit(1)).alias("n"))
