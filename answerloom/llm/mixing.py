"""Mixing sources to target weights (operator 4); DataFrame functions only.

The words of each source are packed into blocks of fixed length. A source's target says how
many slots of the mix it fills. A pseudorandom permutation of all slots deals them to output shards, so
that the counts of a shard are a multinomial draw, given what each source has in all. The n-th slot of a source
takes the block that a pseudorandom permutation of the source's blocks has at
n; each further pass over a source has another permutation. Slots and the pieces of documents meet by
(source, block).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.batches import WORD, running
from answerloom.storage import save

#: Words of a block, slots of a shard.
BLOCK = 128
SHARD = 1024
#: A source of fewer words than make so many blocks has shorter ones, so that targets are met to a part of this.
FEWEST = 32
#: The mix is so large by all words, and a source gives at most so many times its own.
SHARE, MOST = 1.5, 2
ROUNDS = 20
#: Slots that are laid out from one row.
CHUNK = 1 << 16


def targets(sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Shares of the mix by weight; what is above the limit of a source goes to the others by weight."""
    out, left, open_ = np.zeros(len(sizes)), SHARE * float(np.sum(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        total = float(weights[open_].sum())
        above = open_ & (left * weights > MOST * sizes * total)
        if not above.any():
            out[open_] = left * weights[open_] / total
            break
        out[above] = MOST * sizes[above]
        left -= float(out[above].sum())
        open_ &= ~above
    return out


def cycled(names: list[str | None]) -> list[int]:
    """3, 1, 2 and again, for sources by code point with null last."""
    return [(3, 1, 2)[i % 3] for i in range(len(names))]


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, digest): ``size`` is the number of words, 0 for a null text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("digest"))


def sources_of(sizes: DataFrame, weigh=cycled) -> DataFrame:
    """(name, number, source_size, target, length, blocks, slots, first), a row for each source, written.

    ``length``: words of its blocks; ``slots``: how many of the mix it fills; ``first``: slots of the sources before it. The driver works
    this out from one row of each source, as the order of all sources gives their weights.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).toArrow()
    names, size = rows["source"].to_pylist(), rows["size"].to_numpy()
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    names, size = [names[i] for i in order], size[order]
    target = targets(size, np.array(weigh(names), np.float64))
    length = np.clip(size // FEWEST, 1, BLOCK)
    blocks = -(-size // length)
    slots = np.rint(np.divide(target * blocks, size, out=np.zeros(len(size)), where=size > 0)).astype(np.int64)
    made = {"name": pa.array(names, pa.string()), "number": np.arange(len(names)), "source_size": size, "target": target, "length": length}
    made |= {"blocks": blocks, "slots": slots, "first": np.cumsum(slots) - slots}
    return save(sizes.sparkSession.createDataFrame(pa.table(made)), "mix-sources")


def packed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with its source's number, size, target and block length, and the word of the source where it starts.

    Documents of a source follow one another by bucket (a hash of the id) and then id.
    """
    buckets = F.lit(max(1, sizes.count() // 2048))
    of = sources.select("name", "number", "source_size", "target", "length")
    numbered = sizes.join(of, sizes["source"].eqNullSafe(of["name"])).drop("name")
    return running(numbered, ["number"], F.pmod("digest", buckets), ["doc_id", "digest", "size"], {"begin": (F.sum, "size")})


def pieces(placed: DataFrame) -> DataFrame:
    """(number, block, doc_id, begin, size, from_word, n_words): the part of each document in each block it reaches into."""
    first, last = F.floor(F.col("begin") / F.col("length")), F.floor((F.col("begin") + F.col("size") - 1) / F.col("length"))
    cut = placed.filter("size > 0").select("number", "doc_id", "begin", "size", "length", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest("begin", F.col("block") * F.col("length"))
    high = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * F.col("length"))
    return cut.select("number", "block", "doc_id", "begin", "size", (low - F.col("begin")).alias("from_word"), (high - low).alias("n_words"))


def permuted(i: Column, n: Column, salt: Column) -> Column:
    """The place of ``i`` in a pseudorandom permutation of 0 .. n - 1, by swap-or-not rounds (a published shuffle)."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, salt), n) - x, n)
        chosen = F.xxhash64(F.greatest(x, other), r, salt) % 2 == 0
        return F.when(chosen, other).otherwise(x).cast("bigint")

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i.cast("bigint"), step)


def slots(sources: DataFrame, seed: int = 0) -> DataFrame:
    """(shard, slot, number, block): which block fills each slot of the mix."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    rows = sources.filter("slots > 0").select("number", "blocks", "slots", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"))
    rows = rows.repartition(total // (4 * CHUNK) + 1, "number", "chunk")
    end = F.least("slots", (F.col("chunk") + 1) * CHUNK) - 1
    each = rows.select("number", "blocks", "first", F.explode(F.sequence(F.col("chunk") * CHUNK, end)).alias("index"))
    place = permuted(F.col("first") + F.col("index"), F.lit(total).cast("bigint"), F.lit(seed).cast("bigint"))
    salt = F.xxhash64("number", F.floor(F.col("index") / F.col("blocks")), F.lit(seed))
    # written, so that the rounds of the permutations read columns and do not work these out again
    drawn = save(each.select("number", "blocks", (F.col("index") % F.col("blocks")).alias("at"), place.alias("place"), salt.alias("salt")), "mix-slots")
    shard, slot = F.floor(F.col("place") / SHARD), F.col("place") % SHARD
    return drawn.select(shard.alias("shard"), slot.alias("slot"), "number", permuted(F.col("at"), F.col("blocks"), F.col("salt")).alias("block"))


def mixture(placed: DataFrame, sources: DataFrame, seed: int = 0) -> DataFrame:
    """(shard, slot, number, block, doc_id, begin, size, from_word, n_words): what fills every slot, piece by piece."""
    return slots(sources, seed).join(pieces(placed), ["number", "block"])


def taken(docs: DataFrame, weigh=cycled, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, digest, parts), a row for each row of ``docs``.

    ``taken`` are the words that the mix takes of the row, repeats counted; ``parts`` says where they go, as array<struct<shard, slot,
    from_word, n_words>> in that order. A null text has no
    word; a null source is a source of its own, and the last. Rows without a word have 0. Equal rows are packed
    one after the other. A source of any size comes within a block of its target, and its blocks are at most a 32nd of it. The same input gives the same mix. An empty table gives no row. Other columns are not read. ``digest`` is a hash of id and text.
    """
    sizes = save(sized(docs), "mix-sizes")
    sources = sources_of(sizes, weigh)
    placed = save(packed(sizes, sources), "mix-placed")
    part = F.struct("shard", "slot", "from_word", "n_words")
    made = mixture(placed, sources, seed).groupBy("number", "doc_id", "begin", "size").agg(F.sum("n_words").alias("taken"), F.array_sort(F.collect_list(part)).alias("parts"))
    own = [F.col(f"m.{c}") for c in ("number", "doc_id", "begin", "size")]
    same = [F.col(f"p.{c}").eqNullSafe(o) for c, o in zip(("number", "doc_id", "begin", "size"), own, strict=True)]
    rows = placed.alias("p").join(made.alias("m"), same, "left")
    kept = [F.col(f"p.{c}") for c in ("doc_id", "source", "size", "source_size", "target")]
    none = F.array().cast("array<struct<shard: bigint, slot: bigint, from_word: bigint, n_words: bigint>>")
    return rows.select(*kept, F.coalesce("m.taken", F.lit(0).cast("bigint")).alias("taken"), "p.digest", F.coalesce("m.parts", none).alias("parts"))
