"""Threshold-scaled sketches of documents (operator 5).

Of the hashes of all shingles of code points a sketch keeps those below a
fixed share of the hash range, so a long document has a large sketch and a
short one a small one, sketches of parts merge by union, and the share of
the smaller sketch that the larger one has estimates containment between very unequal documents.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.batches import mixed, powers

#: Code points of a shingle; a power of two.
POINTS = 16
#: The share of hashes kept is 2 ** -KEPT_BITS.
KEPT_BITS = 4
#: Rows of a stretch of consecutive documents, and stretches at most (their bounds are broadcast, 8 bytes each).
STRETCH_ROWS = 256
STRETCHES = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def sketch(text: str) -> np.ndarray:
    """Sorted 32-bit hashes: of each kept shingle the bits after the fixed ones.

    A text shorter than a shingle is one shingle. The smallest hash is always
    kept, so only an empty text has an empty sketch.
    """
    if not text:
        return np.zeros(0, np.uint32)
    rolled = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(rolled) < POINTS:
        rolled = np.array([np.sum(rolled * powers(_BASE, len(rolled)))]) + np.uint64(len(rolled))
    else:
        width, power = 1, np.array([_BASE])
        while width < POINTS:
            rolled = rolled[:-width] * power + rolled[width:]
            width, power = 2 * width, power * power
    hashes = mixed(rolled)
    kept = hashes[hashes < np.uint64(1 << 64 - KEPT_BITS)]
    if not len(kept):
        kept = hashes.min(keepdims=True) & np.uint64((1 << 64 - KEPT_BITS) - 1)
    return np.unique((kept >> np.uint64(64 - KEPT_BITS - 32)).astype(np.uint32))


def merged(sketches: list[np.ndarray]) -> np.ndarray:
    """The sketch of all the texts together (but for shingles across their borders)."""
    return np.unique(np.concatenate(sketches)) if sketches else np.zeros(0, np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of the smaller text's shingles that the other has; 1 for two empty sketches, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def written(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u4").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _stretched(docs: DataFrame) -> DataFrame:
    """(stretch, tail, key, doc_id, text) of all documents, and each stretch's successor once more as its tail.

    A stretch is a range of ids, so texts move once and no task sees all.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    n = min(STRETCHES, max(1, rows.count() // STRETCH_ROWS))
    cuts = rows.stat.approxQuantile("key", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = np.array(sorted({int(c) for c in cuts}), np.int64)

    @F.arrow_udf("int")
    def stretch(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, key.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    firsts = sorted((r["stretch"], r["key"]) for r in rows.select("key", stretch("key").alias("stretch")).groupBy("stretch").agg(F.min("key").alias("key")).collect())
    numbers = np.full(len(bounds) + 1, -1, np.int64)
    previous = np.full(len(bounds) + 1, -1, np.int32)
    for i, (number, key) in enumerate(firsts):
        numbers[number], previous[number] = key, firsts[i - 1][0]

    @F.arrow_udf("array<struct<stretch: int, tail: boolean>>")
    def homes(key: pa.Array) -> pa.Array:
        keys = key.to_numpy(zero_copy_only=False)
        own = np.searchsorted(bounds, keys, side="right")
        again = keys == numbers[own]
        ends = np.cumsum(1 + again.astype(np.int32))
        home, tail = np.empty(ends[-1] if len(ends) else 0, np.int32), np.zeros(ends[-1] if len(ends) else 0, bool)
        home[ends - 1 - again] = own
        home[ends[again] - 1], tail[ends[again] - 1] = previous[own[again]], True
        made = pa.StructArray.from_arrays([pa.array(home), pa.array(tail)], ["stretch", "tail"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), made)

    return rows.select("doc_id", "key", "text", F.explode(homes("key")).alias("home")).select("home.stretch", "home.tail", "key", "doc_id", "text")


def with_next(docs: DataFrame) -> DataFrame:
    """The digest of each document and of its edited text; columns as in the contract of the query.

    The next document is the one with the next larger id, after the last one the first. Rows that repeat an
    id are ordered by text and follow one another; rows without an id come
    first. A null text counts as empty. A single document is its own next. Other columns are not read.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next has not come
        for batch in batches:
            rows = []
            columns = [batch.column(c) for c in ("stretch", "tail", "doc_id", "text")]
            for i in range(batch.num_rows):
                stretch, tail, doc_id, text = (c[i].as_py() for c in columns)
                own = sketch(text)
                if held and held[0] == stretch:
                    _, last_id, last_text, last = held
                    other = edited(last_text, text)
                    other_sketch = sketch(other)
                    rows.append((last_id, len(last_text), hashlib.sha256(other.encode()).hexdigest(), written(last), written(other_sketch), likeness(last, other_sketch), likeness(last, own)))
                held = None if tail else (stretch, doc_id, text, own)
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    placed = _stretched(docs).repartition("stretch").sortWithinPartitions("stretch", "tail", "key", "text")
    return placed.mapInArrow(digests, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
