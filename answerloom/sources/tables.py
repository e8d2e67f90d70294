"""CSV and Parquet readers and writers of the question/answer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom import schemas
from answerloom.functions import text
from answerloom.operators.sampling import first_rows


class MissingColumns(ValueError):
    """A CSV header lacks columns that are needed."""


def _csv(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """The columns of ``schema`` by the names in the header, ``_too_long`` and ``_file``; other columns are left out.

    All files below ``path`` need the same header; Spark raises on one that differs. A line that is too
    short gets NULLs, one with more fields than the header is marked.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}
    names = spark.read.options(**options).csv(path).columns
    if missing := [f.name for f in schema if f.name not in names]:
        raise MissingColumns(f"{path} has no column {', '.join(missing)}")
    strings = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_malformed", T.StringType())])
    reader = spark.read.schema(strings).options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_malformed", enforceSchema=False, columnPruning=False)
    too_long = F.col("_malformed").isNotNull() & F.col(f"`{names[-1]}`").isNotNull()
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema]
    return reader.csv(path).select(*typed, too_long.alias("_too_long"), F.col("_metadata.file_path").alias("_file"))


def read_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The question/answer corpus; Parquet unless the path ends in ``.csv``."""
    if path.rstrip("/").endswith(".csv"):
        corpus = _csv(spark, schemas.QA_CORPUS, path).filter("not _too_long").drop("_too_long", "_file")
    else:
        corpus = spark.read.schema(schemas.QA_CORPUS).parquet(path)
    return first_rows(corpus, limit, "question_id", "answer_id")


def read_posts(spark: SparkSession, questions: str, answers: str) -> tuple[DataFrame, DataFrame]:
    """The two posts tables, question posts and answer posts."""
    return (
        spark.read.schema(schemas.QUESTION_POSTS).parquet(questions),
        spark.read.schema(schemas.ANSWER_POSTS).parquet(answers),
    )


def read_eval_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """An evaluation set (qid, question, answer), columns by name.

    Lines with too many fields are skipped, lines with too few get NULLs, and
    missing texts become blank. A quoted line may hold line breaks. ``qid`` is the number of the
    file in the order of paths and of the line in it, so it does not depend on how files are dealt to tasks: such a file is
    read by one task.
    """
    rows = _csv(spark, schemas.EVAL_SET, path).withColumn("_at", F.monotonically_increasing_id())
    files = rows.groupBy("_file").agg(F.min("_at").alias("_first"))
    files = files.withColumn("_number", F.row_number().over(Window.orderBy("_file")) - 1)
    kept = rows.join(files, "_file").filter("not _too_long").select(
        (F.col("_number") * (1 << 33) + F.col("_at") - F.col("_first")).alias("qid"),
        text.text_or_blank(F.col("question")).alias("question"),
        text.text_or_blank(F.col("answer")).alias("answer"),
    )
    return first_rows(kept, limit, "qid")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All fields quoted; reads back exactly with the readers above."""
    df.write.mode(mode).options(header=True, quoteAll=True, escape='"').csv(path)
