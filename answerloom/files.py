"""Flat binary files that tasks memory-map.

Spark's text writer puts them into the shared folder: committed like any table, and there for an
executor that starts later. ``addFile`` hands them to every executor; all Python workers of a machine
then share the mapped pages, and only the pages that are looked at are read.
"""

from __future__ import annotations

import functools
import mmap

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.storage import new_location

#: Parts begin at multiples of this many bytes, so that numbers in them are aligned.
ALIGNED = 8


def packed(*arrays: np.ndarray) -> bytes:
    """The arrays on end, after a head with their number and their lengths in bytes."""
    parts = [a.tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return head + b"".join(p + bytes(-len(p) % ALIGNED) for p in parts)


def handed_out(blobs: DataFrame, name: str) -> list[str]:
    """Write the binary column ``blob`` of ``packed`` rows and give the files to the executors.

    Returns their names, one for each partition with rows. Bytes pass as a string
    column, which the text writer copies as they are.
    """
    spark = blobs.sparkSession
    path = new_location(spark, name)
    writer = blobs.select(F.col("blob").cast("string")).write.option("lineSep", "\n" * ALIGNED).option("compression", "none")
    writer.text(path)
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path").collect()
    for file in files:
        spark.sparkContext.addFile(file.path)
    return sorted(file.path.rsplit("/", 1)[1] for file in files)


@functools.lru_cache(maxsize=4096)
def mapped(name: str) -> list[list[np.ndarray]]:
    """The arrays, as bytes, of every blob of a file."""
    with open(SparkFiles.get(name), "rb") as file:
        data = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
    blobs, at = [], 0
    while at < len(data):
        n = int(data[at : at + 8].view(np.int64)[0])
        lengths = data[at + 8 : at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        parts = []
        for length in lengths.tolist():
            parts.append(data[at : at + length])
            at += length + -length % ALIGNED
        blobs.append(parts)
        at += ALIGNED
    return blobs
