"""How the tokens of two tokenizers correspond (operator 13).

Both token sequences of a text are cut where they end together, by bytes. The last
tokens of such a group are linked. A first pass over the texts gathers the pairs of
linked ids. Their distinct pairs get a minimal perfect hash, and the counts are dense vectors over its
slots, summed in a tree. A second pass aligns the texts again and looks the counts up; the pairs stored by
slot verify every find.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom import files
from answerloom.llm import perfect_hash
from answerloom.llm.batches import slices
from answerloom.storage import save

#: A blank after anything but white space, and not at the end: both tokenizers begin a token there, whatever stands around.
_CUT = re.compile(r"(?<=\S) (?=\s*+\S)")
#: What lies between two such places.
_UNIT = re.compile(r"\s*+\S++(?:[^\S ]\s*+\S++)*+(?:\s++\Z)?|\s+")
#: Code points of a text that are cut into units together.
STRETCH = 1 << 20
#: Units that a task remembers, and code points of those that it does.
REMEMBERED, SHORT = 600_000, 64
#: Pairs that a task gathers before it sends them on.
GATHERED = 500_000
#: Pairs of one perfect hash, about, and vectors that are summed together.
SHARD, FAN = 1 << 19, 8
_ID = np.int64((1 << 32) - 1)
VECTORS = "shard int, part int, counts binary"


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Fixed value: how byte-level vocabularies of this kind cut a text before they merge bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_level(file: bytes):
    """Entries as bytes by id, and a function from a text to its ids, of a tokenizer's JSON file."""
    import tiktoken

    model, of = json.loads(file)["model"], _byte_of()
    entries = {i: bytes(of[c] for c in entry) for entry, i in model["vocab"].items()}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    numbers = [model["vocab"][m] for m in merged]
    if numbers != sorted(numbers):
        raise ValueError("the merges of the vocabulary are not in the order of its ids")
    ranks = {entry: i for i, entry in entries.items()}
    return entries, tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _numbers(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


@dataclass(frozen=True)
class Links:
    """Tokens of units on end. ``last_*``: whether a token ends a group; ``n_*``: tokens of each unit; ``bounds``: where the pairs of each unit begin."""

    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    pairs: np.ndarray
    bounds: np.ndarray

    @classmethod
    def together(cls, parts: list[Links]) -> Links:
        begins = np.cumsum([0, *(len(p.pairs) for p in parts)])
        bounds = np.concatenate([[0], *(p.bounds[1:] + at for p, at in zip(parts, begins[:-1], strict=True))])
        empty = [np.zeros(0, k) for k in (np.int64, np.int64, bool, bool, np.int64, np.int64, np.int64)]
        names = ("a", "b", "last_a", "last_b", "n_a", "n_b", "pairs")
        return cls(*(np.concatenate([none, *(getattr(p, n) for p in parts)]) for n, none in zip(names, empty, strict=True)), bounds)

    def texts(self, marks: tuple[np.ndarray, ...]) -> list[str]:
        """The groups of each unit, every one with ``;`` at its end. ``marks``: ids as text with a comma, with a bar, with a semicolon."""
        closed_a, closed_b = np.cumsum(self.last_a), np.cumsum(self.last_b)
        before_b = np.concatenate([[0], np.flatnonzero(self.last_b) + 1])  # B tokens of all groups before the n-th
        through_a = np.flatnonzero(self.last_a) + 1
        comma, bar, semicolon = marks
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + before_b[closed_a - self.last_a]] = np.where(self.last_a, bar[self.a], comma[self.a])
        out[np.arange(len(self.b)) + through_a[closed_b - self.last_b]] = np.where(self.last_b, semicolon[self.b], comma[self.b])
        tokens, ends = out.tolist(), [0, *np.cumsum(self.n_a + self.n_b).tolist()]
        return ["".join(tokens[i:j]) for i, j in zip(ends, ends[1:], strict=False)]


class Aligner:
    """A byte-level tokenizer (A) and a sentencepiece model with bytes (B)."""

    def __init__(self, a: bytes, b: bytes):
        from sentencepiece import SentencePieceProcessor

        self.a_bytes, self.encode_a = _byte_level(a)
        self.b = SentencePieceProcessor(model_proto=b)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces}
        self.length_a, self.length_b = (np.array([len(of.get(i, b"")) for i in range(max(of) + 1)]) for of in (self.a_bytes, self.b_bytes))
        ids = [str(i) for i in range(max(len(self.length_a), len(self.length_b)))]
        self.marks = tuple(np.array([i + mark for i in ids], object) for mark in ",|;")

    def aligned(self, units: list[str]) -> tuple[list[str], Links]:
        """The units in another order, and the links of the first of them; the others' bytes are not what the tokens of A or B spell.

        Units follow one another in one text for A; one that ends with white space cannot have a next.
        """
        alone = [u for u in units if u[-1].isspace()]
        parts = [[u for u in units if not u[-1].isspace()], *([u] for u in alone)] if alone else [units]
        made, spelled, others = [], [], []
        for part in parts:
            ids = self.b.encode([u[1:] for u in part], num_threads=1)
            if b"".join(map(self.b_bytes.__getitem__, chain.from_iterable(ids))) != "".join(part).encode():
                same = [b"".join(map(self.b_bytes.__getitem__, i)) == u.encode() for u, i in zip(part, ids, strict=True)]
                others += [u for u, good in zip(part, same, strict=True) if not good]
                part, ids = list(compress(part, same)), list(compress(ids, same))
            if part:
                made.append(self._linked(part, ids))
                spelled += part
        return spelled + others, made[0] if len(made) == 1 else Links.together(made)

    def _linked(self, units: list[str], ids: list[list[int]]) -> Links:
        text = "".join(units)
        a, b = np.array(self.encode_a(text), np.int64), _numbers(ids)
        ends = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in units])
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at_a, at_b = np.zeros(ends[-1] + 1, bool), np.zeros(ends[-1] + 1, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        last_a, last_b = at_b[ends_a], at_a[ends_b]
        n_a = np.diff(np.searchsorted(ends_a, ends, side="right"), prepend=0)
        bounds = np.searchsorted(ends_a[last_a], ends, side="right")
        pairs = a[last_a] << 32 | b[last_b]
        return Links(a, b, last_a, last_b, n_a, np.array(list(map(len, ids))), pairs, np.concatenate([[0], bounds]))


@functools.lru_cache(maxsize=2)
def _aligner(a: bytes, b: bytes) -> Aligner:
    return Aligner(a, b)


def unit_lists(text: str) -> Iterator[list[str]]:
    """The units of a blank and the text, a bounded stretch at a time."""
    text, at = " " + text, 0
    while at < len(text):
        cut = _CUT.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        stop = cut.start() if cut else len(text)
        yield _UNIT.findall(text, at, stop)
        at = stop


class _Column:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if (need := self.size + len(values)) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(need, len(self.data)), self.data.dtype)])
        self.data[self.size : need] = values
        self.size = need

    def cut(self, size: int) -> None:
        self.size = min(self.size, size)

    @property
    def values(self) -> np.ndarray:
        return self.data[: self.size]


class _Units:
    """Numbers for units, and what ``self.keep`` stores of each by number. Short units are remembered up to a bound, long ones until the next lists."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.passing: list[str] = []
        self.spelled = _Column(bool)

    def numbers(self, lists: list[list[str]]) -> np.ndarray:
        """The numbers of all units of the lists."""
        for unit in self.passing:
            del self.number[unit]
        self.cut(len(self.number))
        used = set().union(*lists)
        new = list(used.difference(self.number))
        if len(self.number) + len(new) > REMEMBERED:
            self.forget()
            new = list(used)
        long = [u for u in new if len(u) > SHORT]
        short = [u for u in new if len(u) <= SHORT] if long else new
        for part in (*(short[low : low + 10_000] for low in range(0, len(short), 10_000)), long):
            if part:
                units, links = self.aligner.aligned(part)
                self.number.update(zip(units, range(len(self.number), len(self.number) + len(units)), strict=True))
                n = len(links.n_a)
                self.spelled.extend(np.arange(len(units)) < n)
                self.keep(links, len(units) - n)
        self.passing = long
        return np.fromiter(map(self.number.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))


class _Pairs(_Units):
    """How often the units occur; their pairs."""

    def __init__(self, aligner: Aligner):
        self.total: Counter = Counter()
        self.times = None
        super().__init__(aligner)

    def forget(self) -> None:
        if self.times is not None:
            self.spread(0)
        super().forget()
        self.times, self.n_pairs, self.pairs = _Column(np.int64), _Column(np.int64), _Column(np.int64)

    def cut(self, size: int) -> None:
        self.spread(size)
        self.pairs.cut(int(self.n_pairs.values[:size].sum()))
        for column in (self.spelled, self.times, self.n_pairs):
            column.cut(size)

    def keep(self, links: Links, others: int) -> None:
        self.n_pairs.extend(np.concatenate([np.diff(links.bounds), np.zeros(others, np.int64)]))
        self.times.extend(np.zeros(len(links.n_a) + others, np.int64))
        self.pairs.extend(links.pairs)

    def count(self, numbers: np.ndarray) -> None:
        self.times.values[:] += np.bincount(numbers, minlength=self.times.size)

    def spread(self, begin: int) -> None:
        """Count the pairs of all units from number ``begin`` on."""
        if self.times.size > begin:
            at = int(self.n_pairs.values[:begin].sum())
            pairs, into = np.unique(self.pairs.values[at:], return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, into, np.repeat(self.times.values[begin:], self.n_pairs.values[begin:]))
            self.total.update(dict(zip(pairs[n > 0].tolist(), n[n > 0].tolist(), strict=True)))
            self.times.values[begin:] = 0

    def sent(self) -> pa.RecordBatch:
        columns = [pa.array(np.fromiter(x, np.int64, len(self.total))) for x in (self.total.keys(), self.total.values())]
        self.total.clear()
        return pa.RecordBatch.from_arrays(columns, ["pair", "n"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[list[list[str]]]]]:
    """Batches, and the units of their texts: of one long text a stretch at a time, of others one list each."""
    for batch in slices(batches, "text"):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        if len(texts) == 1 and len(texts[0]) > STRETCH:
            yield batch, ([units] for units in unit_lists(texts[0]))
        else:
            yield batch, iter([[_UNIT.findall(" " + t) if t else [] for t in texts]])


def _gatherer(shared):
    """Of each task the pairs of ids that are linked in its texts, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Pairs(_aligner(*shared.value))
        for batch, steps in _texts(batches):
            long, own = batch.num_rows == 1, Counter()
            for lists in steps:
                numbers = known.numbers(lists)
                good = known.spelled.values[numbers]
                if long:  # a text counts as a whole or not at all
                    if not good.all():
                        break
                    for units in lists:
                        own.update(units)
                    continue
                if not good.all():
                    row = np.repeat(np.arange(len(lists)), list(map(len, lists)))
                    numbers = numbers[np.isin(row, row[~good], invert=True)]
                known.count(numbers)
            else:
                for low in range(0, len(own), 100_000):
                    part = dict(islice(own.items(), low, low + 100_000))
                    numbers = known.numbers([list(part)])
                    known.times.values[numbers] += np.fromiter(part.values(), np.int64, len(part))
            if len(known.total) > GATHERED:
                yield known.sent()
        known.spread(0)
        yield known.sent()

    return run


def _hasher(shards: int):
    """One blob for each shard of the pairs in a partition: the shard, its hash, the pairs by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column("pair").to_numpy() for b in batches if b.num_rows]
        pairs = np.concatenate([*held, np.zeros(0, np.int64)])
        of = shard_of(pairs, shards)
        for shard in np.unique(of):
            made = perfect_hash.build(pairs[of == shard])
            blob = files.packed(np.array([shard]), made.starts, made.bits, made.ranks, made.keys)
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

    return run


def shard_of(pair, shards: int):
    """The shard of a pair, for a column and for an array."""
    return (pair % ((1 << 31) - 1)) % shards


@functools.lru_cache(maxsize=4)
def _hashes(names: tuple[str, ...]) -> dict[int, perfect_hash.PerfectHash]:
    blobs = [blob for name in names for blob in files.mapped(name)]
    return {int(b[0].view(np.int64)[0]): perfect_hash.PerfectHash(*(x.view(kind) for x, kind in zip(b[1:], (np.int64, np.uint64, np.int64, np.int64), strict=True))) for b in blobs}


@functools.lru_cache(maxsize=4)
def _counts(names: tuple[str, ...]) -> dict[int, np.ndarray]:
    return {int(b[0].view(np.int64)[0]): b[1].view(np.int64) for name in names for b in files.mapped(name)}


def _vector(shard: int, part: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["shard", "part", "counts"])


def _counter(names: tuple[str, ...]):
    """Dense vectors of the gathered pairs, sorted by (shard, part): one for each run of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(0, np.int64)
        for batch in batches:
            shard, part, pair, n = (batch.column(c).to_numpy() for c in ("shard", "part", "pair", "n"))
            edges = [0, *(np.flatnonzero(np.diff(shard) | np.diff(part)) + 1).tolist(), len(shard)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                if (own := (int(shard[low]), int(part[low]))) != at:
                    if at:
                        yield _vector(*at, total)
                    at, total = own, np.zeros(len(_hashes(names)[own[0]].keys), np.int64)
                np.add.at(total, _hashes(names)[at[0]].slots(pair[low:high]), n[low:high])
        if at:
            yield _vector(*at, total)

    return run


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of vectors that are sorted by (shard, part), one for each run of both."""
    at, total = None, None
    for batch in batches:
        for shard, part, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "counts")), strict=True):
            vector = np.frombuffer(counts, np.int64)
            if at == (shard, part):
                total += vector
                continue
            if at:
                yield _vector(*at, total)
            at, total = (shard, part), vector.copy()
    if at:
        yield _vector(*at, total)


def _best(names: tuple[str, ...]):
    """(b, best) of each vector: the highest count of each B id in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, counts in zip(batch.column("shard").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                b = _hashes(names)[shard].keys & _ID
                ids, place = np.unique(b, return_inverse=True)
                best = np.zeros(len(ids), np.int64)
                np.maximum.at(best, place, np.frombuffer(counts, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best)], ["b", "best"])

    return run


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [files.packed(np.array([s]), np.frombuffer(c, np.int64)) for s, c in zip(batch.column("shard").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["blob"])


@dataclass(frozen=True)
class PairCounts:
    """Files of the hashes and of the counts by slot; ``best``: (B ids, highest count of each), as long as B's vocabulary at most."""

    shards: int
    hashes: tuple[str, ...]
    counts: tuple[str, ...]
    best: tuple[np.ndarray, np.ndarray]

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 for one that is not known."""
        out, shard = np.zeros(len(pairs), np.int64), shard_of(pairs, self.shards)
        for number in np.unique(shard).tolist():
            if number in (held := _hashes(self.hashes)):
                here = np.flatnonzero(shard == number)
                slots = held[number].slots(pairs[here])
                out[here] = np.where(slots >= 0, _counts(self.counts)[number][np.maximum(slots, 0)], 0)
        return out


def pair_counts(gathered: DataFrame) -> PairCounts:
    """The counts of a table (pair, n) that may have a pair many times; ``pair`` is A's id times 2**32 plus B's.

    Vectors are as long as a shard has pairs, and there are as many at first as make them no more numbers than the table has
    rows; ``FAN`` of them at a time are summed until each shard has one.
    """
    rows, distinct = gathered.count(), save(gathered.select("pair").distinct(), "pairs")
    n = distinct.count()
    shards = n // SHARD + 1
    if not n:
        return PairCounts(1, (), (), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    of = shard_of(F.col("pair"), shards).cast("int")
    spread = distinct.repartition(shards, of)
    names = tuple(files.handed_out(spread.mapInArrow(_hasher(shards), "blob binary"), "pair-hashes"))
    parts = rows // (FAN * n) + 1
    part = F.pmod(F.spark_partition_id(), F.lit(parts)).cast("int")
    placed = gathered.select(of.alias("shard"), part.alias("part"), "pair", "n").repartition("shard", "part").sortWithinPartitions("shard", "part")
    vectors = placed.mapInArrow(_counter(names), VECTORS)
    while parts > 1:
        parts = -(-parts // FAN)
        up = vectors.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        vectors = up.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(_adder, VECTORS)
    vectors = save(vectors, "pair-vectors")
    counts = tuple(files.handed_out(vectors.mapInArrow(_blobs, "blob binary"), "pair-counts"))
    best = vectors.mapInArrow(_best(names), "b bigint, best bigint").groupBy("b").agg(F.max("best").alias("best")).orderBy("b").toArrow()
    return PairCounts(shards, names, counts, (best["b"].to_numpy(), best["best"].to_numpy()))


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class _Counted(_Units):
    """Tokens, links, best links and counts of the units, and their groups as text."""

    def __init__(self, aligner: Aligner, counts: PairCounts):
        self.counts = counts
        super().__init__(aligner)

    def forget(self) -> None:
        super().forget()
        self.columns, self.texts = [_Column(np.int64) for _ in range(5)], []

    def cut(self, size: int) -> None:
        del self.texts[size:]
        for column in (self.spelled, *self.columns):
            column.cut(size)

    def keep(self, links: Links, others: int) -> None:
        ids, best = self.counts.best
        # a pair of a text that counts for nothing may be unknown, and its B id too
        found, place = self.counts.of(links.pairs), np.searchsorted(ids, links.pairs & _ID)
        tops = np.concatenate([best, [-1]])[np.minimum(place, len(ids))] == found
        sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[links.bounds]) for x in (tops, found)]
        for column, values in zip(self.columns, (links.n_a, links.n_b, np.diff(links.bounds), *sums), strict=True):
            column.extend(np.concatenate([values, np.zeros(others, np.int64)]))
        self.texts += [*links.texts(self.aligner.marks), *([""] * others)]


def _looker(shared, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Counted(_aligner(*shared.value), counts.value)
        for batch, steps in _texts(batches):
            sums = np.zeros((5, batch.num_rows), np.int64)
            digests, good = [None] * batch.num_rows, np.ones(batch.num_rows, bool)
            for lists in steps:
                numbers, sizes = known.numbers(lists), np.array(list(map(len, lists)))
                row = np.repeat(np.arange(len(lists)), sizes)
                good[row[~known.spelled.values[numbers]]] = False
                ends = np.concatenate([[0], np.cumsum(sizes)])
                for total, column in zip(sums, known.columns, strict=True):
                    total += np.diff(np.concatenate([[0], np.cumsum(column.values[numbers])])[ends])
                listed, ends = numbers.tolist(), ends.tolist()
                for i in np.flatnonzero(good & (sizes > 0)).tolist():
                    text = "".join(map(known.texts.__getitem__, listed[ends[i] : ends[i + 1]]))[:-1].encode()
                    if digests[i] is None:
                        digests[i] = hashlib.sha256(text)
                    else:
                        digests[i].update(b";" + text)
                if not good.any():
                    break
            sums *= good
            made = [d.hexdigest() if d and ok else "" for d, ok in zip(digests, good.tolist(), strict=True)]
            a, b, links, n_best, total = map(pa.array, sums)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), a, b, links, links, n_best, total, pa.array(made)], ["doc_id", *COLUMNS, "groups_sha256"])

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of ``docs``.

    ``n_groups``: groups between places where both tokenizers' tokens end; ``n_links``: their pairs of last tokens; ``n_best``: links
    whose count over all rows is the highest of their B id; ``count_sum``: counts of all links; the
    digest is of ``a1,a2|b1;a3|b2,b3``. A text that is null or empty, or whose tokens do not spell it, has zeros and an empty digest, and
    its links do not count. Rows without an id and repeated rows are counted as they are; an empty table gives no row; other
    columns are not read. A text of any length is cut where both tokenizers begin a token anyway and held as a bounded stretch.
    The files of the tokenizers are read by the driver, and broadcast; they do not grow with the corpus.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((Path(a_path).read_bytes(), Path(b_path).read_bytes()))
    texts = docs.select("doc_id", "text")
    gathered = save(texts.mapInArrow(_gatherer(shared), "pair bigint, n bigint"), "linked-pairs")
    counts = context.broadcast(pair_counts(gathered))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_looker(shared, counts), f"doc_id {kind}, {', '.join(f'{c} bigint' for c in COLUMNS)}, groups_sha256 string")
