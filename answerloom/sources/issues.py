"""Issue documents, one JSON file each, in a tree of folders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom import schemas, storage
from answerloom.operators.sampling import stratified_sample

#: Bytes and files that one task opens, about.
TASK_BYTES, TASK_FILES = 64 << 20, 5_000
#: Bytes of contents in one batch of rows.
BATCH_BYTES = 16 << 20
#: Tasks that list files, for each core. Spark makes one for every few files, as if these were large.
LISTING_TASKS = 4


def list_files(spark: SparkSession, root: str, leaf_only: bool = True) -> DataFrame:
    """(path, folder, length) of the JSON files below ``root``. File contents are not read, and the list is written once.

    With ``leaf_only`` a folder counts only if no folder with JSON files lies
    below it. Folders without any are not seen.
    """
    files = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup=True, pathGlobFilter="*.json")
        .load(root)
        .select("path", F.regexp_extract("path", "^(.*)/", 1).alias("folder"), "length")
    )
    files = storage.save(files.coalesce(LISTING_TASKS * spark.sparkContext.defaultParallelism), "issue-list")
    if not leaf_only:
        return files
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    parents = files.select("folder").distinct().select(F.explode(above).alias("folder")).distinct()
    return files.join(parents, "folder", "left_anti").select("path", "folder", "length")


def sample_files(files: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    return stratified_sample(files, "folder", "path", ratio, seed)


def read_issues(files: DataFrame) -> DataFrame:
    """Parse the listed files (path, length): (path, title, body, comments_details, malformed). Files that are not UTF-8 are malformed.

    Only these files are opened, in the executors; the list is dealt to tasks by bytes and is never in one place, however long it is.
    """
    dealt = storage.save(files.select("path", "length"), "issue-files")
    size, n = dealt.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    dealt = dealt.repartition(max(size // TASK_BYTES, n // TASK_FILES) + 1, "path")
    contents = dealt.mapInArrow(_opened, "path string, content binary")
    contents = contents.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("value"))
    schema = T.StructType([*schemas.ISSUE.fields, T.StructField("_malformed", T.StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    return contents.select("path", "value", parsed.alias("issue")).select(
        "path",
        "issue.title",
        "issue.body",
        "issue.comments_details",
        (F.col("value").isNull() | F.col("issue._malformed").isNotNull()).alias("malformed"),
    )


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each path, by the file system that its scheme names."""
    systems: dict[str, fs.FileSystem] = {}
    paths, contents, held = [], [], 0
    for batch in batches:
        for path in batch.column("path").to_pylist():
            scheme, _, rest = path.partition(":")
            base = f"{scheme}://{rest.removeprefix('//').partition('/')[0]}" if rest.startswith("//") else f"{scheme}://"
            if base not in systems:
                systems[base] = fs.LocalFileSystem() if scheme == "file" else fs.FileSystem.from_uri(base)[0]
            name = "/" + rest.lstrip("/") if scheme == "file" else rest.removeprefix("//")
            with systems[base].open_input_stream(name) as file:
                contents.append(file.read())
            paths.append(path)
            held += len(contents[-1])
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], ["path", "content"])
                paths, contents, held = [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
