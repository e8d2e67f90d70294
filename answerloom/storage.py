"""Intermediate tables in the shared checkpoint folder.

A written table cuts the lineage and outlives a lost executor. Unlike
``DataFrame.checkpoint`` it is computed once, and reads back with column
pruning.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="answerloom-"))
    return spark.sparkContext.getCheckpointDir()


def new_location(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, location: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and return a reader of the written table."""
    spark = df.sparkSession
    path = location or new_location(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def commit(spark: SparkSession, path: str, text: str) -> None:
    """Make the file ``path`` with ``text`` in one step; raises ``FileExistsError`` if there is one.

    The text is written beside it under a hidden name and then renamed, so no reader sees half of it and of two writers
    of the same name one fails.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    hidden = hadoop.Path(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    strict = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(hidden, target, strict)
    except Py4JJavaError as error:
        system.delete(hidden, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            raise FileExistsError(path) from None
        raise


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the visible files of a folder, in order; a missing folder has none."""
    try:
        files = spark.read.format("binaryFile").load(folder).select("path").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(f.path.rsplit("/", 1)[1] for f in files)


def read_if_present(spark: SparkSession, path: str, schema) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(schema).parquet(path)
