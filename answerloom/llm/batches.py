"""Small shared pieces: Arrow slices of bounded size, word and shingle hashes, two-level running totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What separates words, everywhere in this package: blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(column: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is held out."""
    return F.coalesce(F.crc32(column.cast("string")) % modulus == remainder, F.lit(True))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and the offsets of the texts in them; null is empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or at[0] == at[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a published finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word with A-Z in lower case, and the number of words of each text."""
    data, at = text_bytes(array)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    begins[edges] = ~space[edges]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, at))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    value = _LOWER[data].astype(np.uint64) + np.uint64(1)
    value[space] = 0
    place = np.zeros(len(data), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    place[space] = 0
    value *= powers(_BASE, int(place.max()) + 1)[place]
    return mixed(np.add.reduceat(value, starts)), counts


def grams(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, the number of the text of each, and the place of its first word."""
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(ends - counts, counts)
    kept = place + width <= np.repeat(counts, counts)
    total = np.zeros(len(words), np.uint64)
    for j, power in enumerate(powers(_STEP, width)[: len(words)]):
        total[: len(words) - j] += words[j:] * power
    return mixed(total[kept]), text[kept], place[kept]


def shingle_sets(array: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ordered by text and hash, and the number of the text of each.

    A text with fewer words has its whole sequence as one; a text without words has none.
    """
    words, counts = word_hashes(array)
    hashes, text, _ = grams(words, counts, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        ends = np.cumsum(counts)
        whole = [np.sum(words[ends[i] - counts[i] : ends[i]] * powers(_STEP, counts[i])) for i in short]
        whole = mixed(np.array(whole, np.uint64) + counts[short].astype(np.uint64) * np.array([_BASE]))
        hashes, text = np.concatenate([hashes, whole]), np.concatenate([text, short])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[first], text[first]


def running(df: DataFrame, group: list[str], bucket: Column, order: list[str], totals: dict[str, tuple]) -> DataFrame:
    """Add for each name in ``totals`` an aggregate of the group's rows before this one, by bucket and then ``order``.

    ``totals``: name -> (aggregate function, column); an empty range gives 0. Two levels, so that no task holds a whole group: an
    aggregate of each bucket, a running one over the buckets of the group, and one inside the
    bucket; the function has to merge its own results. The bucket has to be a function of the row.
    """
    part = fresh(df, "bucket_of_total")
    placed = df.withColumn(part, bucket)
    keys = [*group, part]
    own = [fresh(placed, f"key_of_total_{i}") for i in range(len(keys))]
    before = {name: fresh(placed, f"{name}_before") for name in totals}
    sums = placed.groupBy(*[F.col(c).alias(k) for c, k in zip(keys, own, strict=True)]).agg(*[f(c).alias(before[n]) for n, (f, c) in totals.items()])
    earlier = Window.partitionBy(*own[:-1]).orderBy(own[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*own, *[F.coalesce(f(b).over(earlier), F.lit(0)).alias(b) for (f, _), b in zip(totals.values(), before.values(), strict=True)])
    same = [placed[c].eqNullSafe(sums[k]) for c, k in zip(keys, own, strict=True)]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = placed.join(sums, same)
    merge = {n: (lambda a, b: a.bitwiseXOR(b)) if f is F.bit_xor else (lambda a, b: a + b) for n, (f, _) in totals.items()}
    return both.withColumns({n: merge[n](F.col(before[n]), F.coalesce(f(c).over(inside), F.lit(0))) for n, (f, c) in totals.items()}).drop(part, *own, *before.values())
