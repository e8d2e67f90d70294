"""Benchmark passages in documents, also edited ones (operator 2).

Word n-grams of the test items are the seeds. A first scan counts how many
documents have each seed; a second one takes the rare seeds of each document,
cuts out the stretch around them and aligns it with the item (Smith-Waterman over
words). Items are the stated query set: they come in blocks of bounded size,
and every block meets all documents without a shuffle of texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.batches import WORD, fresh, grams, slices, word_hashes

SEED = 3
#: A seed is rare if at most this share of documents has it, or no more documents than the median seed of its stretch.
RARE_SHARE = 2e-4
#: Words of items in one block; what is broadcast is a few times 8 bytes for each.
BLOCK_WORDS = 500_000
#: Values of the alignment, and the least score as a share of the item's words.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
LEAST_SCORE = 0.5
#: A score of so many matched words tells by itself, however long the item is.
QUOTED = 30
#: An item of fewer words has to stand there word for word, as parts of it cannot be told from chance.
LEAST_WORDS = 6
#: Of each stretch of so many seeds of an item at least half count as rare, so that any quotation has some.
STRETCH = 12

MATCHES = "array<struct<item_id: bigint, score: double, start: bigint, end: bigint>>"


@dataclass
class Block:
    """Seeds sorted by hash, where they stand in which item, and the word hashes of the items."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    at: np.ndarray  # of each seed the range of its places
    item: np.ndarray
    place: np.ndarray

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are seeds, and the number of the seed of each."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.filter[(hashes & np.uint64(self.filter.size - 1)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.seeds, hashes[maybe]), len(self.seeds) - 1)
        real = self.seeds[number] == hashes[maybe]
        return maybe[real], number[real]

    def __post_init__(self):
        size = 1 << max(16, int(len(self.seeds) * 16).bit_length())
        self.filter = np.zeros(size, bool)
        self.filter[(self.seeds & np.uint64(size - 1)).astype(np.int64)] = True

    def only(self, kept: np.ndarray) -> Block:
        """The block with the seeds and places marked in ``kept`` (one mark for each place)."""
        number = np.repeat(np.arange(len(self.seeds)), np.diff(self.at))[kept]
        left = np.unique(number)
        at = np.append(np.searchsorted(number, left), len(number))
        return Block(self.ids, self.words, self.seeds[left], at, self.item[kept], self.place[kept])


def block_of(items: list[tuple[int, str]]) -> Block:
    array = pa.array([t for _, t in items], pa.string())
    words, counts = word_hashes(array)
    ends = np.cumsum(counts)
    own = [words[e - c : e] for e, c in zip(ends, counts, strict=True)]
    hashes, item, place = _grams_of_long(own)
    order = np.lexsort((place, item, hashes))
    hashes, item, place = hashes[order], item[order], place[order]
    seeds, at = np.unique(hashes, return_index=True)
    return Block([i for i, _ in items], own, seeds, np.append(at, len(hashes)), item, place)


def _grams_of_long(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    long = [i for i, w in enumerate(own) if len(w) >= SEED]
    words = np.concatenate([own[i] for i in long]) if long else np.zeros(0, np.uint64)
    hashes, item, place = grams(words, np.array([len(own[i]) for i in long], np.int64), SEED)
    return hashes, np.array(long, np.int64)[item], place


def aligned(item: np.ndarray, words: np.ndarray) -> tuple[float, int]:
    """Best local alignment score, and where in ``words`` it ends (the last matched word); row by row.

    Within a row a gap is carried on by a running maximum.
    """
    slope = -GAP * np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1)
    best, end = 0.0, -1
    for w in item:
        new = np.zeros(len(words) + 1)
        new[1:] = np.maximum(row[:-1] + np.where(words == w, MATCH, MISMATCH), row[1:] + GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + slope) - slope, 0)
        if (top := row.max()) > best:
            best, end = float(top), int(row.argmax()) - 1
    return best, end


def matches(block: Block, words: np.ndarray, hits: np.ndarray, numbers: np.ndarray) -> list[dict]:
    """Alignments of one text that reach the least score, or ``QUOTED``: of each item the best, the first of equals.

    ``hits``: places of seeds in the text; ``numbers``: which seed.
    """
    reach = np.diff(block.at)[numbers]
    index = np.repeat(block.at[numbers], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    item = block.item[index]
    size = np.array([len(block.words[i]) for i in item])
    begin = np.repeat(hits, reach) - block.place[index] - size // 2
    out = []
    order = np.lexsort((begin, item))
    i = 0
    while i < len(order):
        own = item[order[i]]
        m = len(block.words[own])
        best = (0.0, 0, 0)
        while i < len(order) and item[order[i]] == own:
            low = begin[order[i]]
            high = low + 2 * m
            while i + 1 < len(order) and item[order[i + 1]] == own and begin[order[i + 1]] <= high:
                i += 1
                high = begin[order[i]] + 2 * m
            i += 1
            low = max(low, 0)
            part = words[low : high + 1]
            score, end = aligned(block.words[own], part)
            least = min(LEAST_SCORE * m, QUOTED) if m >= LEAST_WORDS else m
            if score >= least and score > best[0]:
                _, back = aligned(block.words[own][::-1], part[: end + 1][::-1])
                best = (score, low + end - back, low + end + 1)
        if best[0]:
            out.append({"item_id": block.ids[own], "score": round(best[0] / m, 6), "start": int(best[1]), "end": int(best[2])})
    return out


def _seed_counts(docs: DataFrame, text: str, shared) -> tuple[int, dict[int, int]]:
    """The number of documents, and of those with each seed; what comes to the driver is one row for each seed of the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, totals, rows = shared.value, np.zeros(len(shared.value.seeds), np.int64), 0
        for batch in slices(batches, "text"):
            words, counts = word_hashes(batch.column("text"))
            hashes, texts, _ = grams(words, counts, SEED)
            where, number = block.found(hashes)
            pairs = np.unique(texts[where] * len(totals) + number)
            totals += np.bincount(pairs % max(len(totals), 1), minlength=len(totals))
            rows += batch.num_rows
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(totals[seen], rows))], ["seed", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    got = {r["seed"]: r["n"] for r in counted.collect()}
    return got.pop(-1, 0), got


def rare(block: Block, docs: int, counts: dict[int, int]) -> Block:
    """The block with rare seeds only; every stretch of an item keeps at least half of its seeds."""
    number = np.repeat(np.arange(len(block.seeds)), np.diff(block.at))
    having = np.array([counts.get(int(i), 0) for i in number], np.int64)
    stretches, of = np.unique(np.stack([block.item, block.place // STRETCH]), axis=1, return_inverse=True)
    return block.only(having <= np.maximum(RARE_SHARE * docs, _medians(of, having, stretches.shape[1])[of]))


def _medians(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, group))
    sizes = np.bincount(group, minlength=n)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(n)
    full = np.flatnonzero(sizes)
    out[full] = values[order][starts[full] + sizes[full] // 2]
    return out


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The items in blocks of about ``BLOCK_WORDS`` words, by a hash of the id; null texts are left out."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    total = items.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_WORDS))
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield block_of([(r["item_id"], r["text"]) for r in rows])


def marked(docs: DataFrame, benchmark: DataFrame, text: str | Column = "text") -> DataFrame:
    """All columns of ``docs`` with the array column ``leaks``: item_id, score, start, end.

    ``score`` is the alignment score by the item's words, 1 at most; it reaches ``LEAST_SCORE`` or stands for ``QUOTED`` matched
    words of a long item, and is 1 for an item with fewer than ``LEAST_WORDS`` words; ``start`` and ``end`` are word numbers (end exclusive) of the best alignment in the whole text.
    Null and empty texts have none; items of fewer words than a seed (``SEED``) are found nowhere. Equal items all match, repeated rows each have their
    own, and null ids do not matter; a text of any length is searched as a whole. If ``docs`` has a
    column ``leaks``, the new one gets a longer name, and is the last.
    """
    spark, name = docs.sparkSession, fresh(docs, "leaks")
    source = text if isinstance(text, Column) else F.col(text)
    found = []
    for block in blocks(benchmark):
        first = spark.sparkContext.broadcast(block)
        counts = _seed_counts(docs.select(source.alias("text")), "text", first)
        first.unpersist()
        found.append(_finder(spark.sparkContext.broadcast(rare(block, *counts)))(source))
    return docs.withColumn(name, F.concat(*found))


def _finder(shared):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(MATCHES)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = shared.value
        for batch in batches:
            out = []
            for piece in slices([pa.RecordBatch.from_arrays([batch], ["text"])], "text"):
                words, counts = word_hashes(piece.column("text"))
                hashes, texts, places = grams(words, counts, SEED)
                where, number = block.found(hashes)
                ends = np.cumsum(counts)
                rows = [[] for _ in range(piece.num_rows)]
                edges = [*np.flatnonzero(np.diff(texts[where], prepend=-1)), len(where)]
                for a, b in itertools.pairwise(edges):
                    t = texts[where[a]]
                    rows[t] = matches(block, words[ends[t] - counts[t] : ends[t]], places[where[a:b]], number[a:b])
                out += rows
            yield pa.array(out, kind)

    return find


def pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word), a row for each document and item it has; see :func:`marked`."""
    found = marked(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.score", F.col("leak.start").alias("start_word"), F.col("leak.end").alias("end_word"))
