"""Question/answer tables derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a table that comes in fewer splits than there are cores.

    Only for plain scans. At scale a scan has more splits than cores, and
    nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def first_line(column: Column) -> Column:
    return F.substring_index(column, "\n", 1)


def other_lines(column: Column) -> Column:
    at = F.instr(column, "\n")
    return F.when(at > 0, F.substring(column, at + 1, F.length(column))).otherwise("")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as question/answer pairs: the first line asks, the rest is body and answer."""
    return documents(spark, sf_dir).select(
        "doc_id",
        first_line(F.col("text")).alias("title"),
        other_lines(F.col("text")).alias("body"),
        F.concat("lang", F.lit("|"), "source").alias("tags"),
        other_lines(F.col("text")).alias("answer"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("qid"), "conv_id", "turn", "role", "text"
    )


def user_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).filter("role = 'user'").select("qid", "text")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question, answer): a user turn and the assistant turn right after it."""
    asked = turns(spark, sf_dir).filter("role = 'user'").select("qid", F.col("text").alias("question"))
    replied = turns(spark, sf_dir).filter("role = 'assistant'").select(
        (F.col("qid") - 1).alias("qid"), F.col("text").alias("answer")
    )
    return asked.join(replied, "qid")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs as prediction (what was asked) and truth (what was answered)."""
    return spread_rows(pairs(spark, sf_dir)).select(
        "qid", F.col("question").alias("prediction"), F.col("answer").alias("truth")
    )


def spread_rows(df: DataFrame) -> DataFrame:
    """Even out rows of very different cost over the cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 2, "qid")


def reactions(score: Column, liked: Column) -> Column:
    return F.struct(
        (score % 4).cast("int").alias("+1"), (liked % 2).cast("int").alias("heart"), F.lit(None).cast("int").alias("hooray")
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One issue per pair: the question asks, the lines of the answer are the comments."""
    comments = F.transform(
        F.split("answer", "\n"),
        lambda line, i: F.struct(line.alias("body"), reactions(F.length(line), i).alias("reactions")),
    )
    return pairs(spark, sf_dir).select(
        "qid",
        first_line(F.col("question")).alias("title"),
        other_lines(F.col("question")).alias("body"),
        comments.alias("comments_details"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded texts (stage, variant, qid, text) made from the pairs."""
    text, size = F.col("answer"), F.length("answer")

    def entry(stage: str, variant: str, made: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), F.lit(variant).alias("variant"), made.alias("text"))

    def boxed(first: Column) -> Column:
        return F.when(first, F.lit("choice: \\boxed{A}")).otherwise(F.lit("choice: \\boxed{B}"))

    made = F.array(
        entry("draft", "A", first_line(text)),
        entry("draft", "B", other_lines(text)),
        entry("draft_choice", "A", boxed(size % 2 == 0)),
        entry("feedback", "A", F.concat(F.lit("shorten by "), (size % 7).cast("string"))),
        entry("refined", "A", text),
        entry("refined", "B", F.concat(F.col("question"), F.lit("\n"), text)),
        entry("refined_choice", "A", boxed(size % 3 == 0)),
        entry("baseline", "A", F.concat(F.lit(" "), F.col("question"), F.lit("\n"))),
        entry("judge", "A", F.concat(F.lit("\\boxed{0."), (size % 5).cast("string"), F.lit("}"))),
    )
    return pairs(spark, sf_dir).select("qid", F.explode(made).alias("r")).select("r.stage", "r.variant", "qid", "r.text")
