"""Spelling variants of the words of a corpus (operator 11).

Words one edit apart agree outside a window of their letters: cut the shorter word into windows, and the edit
lies in one of them. Words meet by what stands outside a window. For the words that meet there is an index of the window: for every
place and letter a bitset of the words that have it there. A query word keeps the bitset of words without
an error so far and that of words with one, and moves both on letter by letter, where a letter too many or too few
looks at the next or the last place. One step does all words at once. Words that very many share a window
with meet again by narrower windows.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.batches import slices
from answerloom.storage import save

#: Letters, as a range of a pattern.
LETTERS = "A-Za-zÀ-ÿ"
#: One in so many runs of letters, by the checksum of row and run, loses a letter.
DROPPED = 31
#: A word counts with this many code points and occurrences.
LENGTH, OCCURRENCES = 7, 2
#: A word's form occurs this many times as often.
RATIO = 10
#: Words that meet in one index, and rows of a task.
MEETING, ROWS = 4096, 200_000
#: Distinct words, and their code points, that a task counts before it sends them on.
COUNTED, CODE_POINTS = 300_000, 1 << 24
#: Code points of a text that are read together.
STRETCH = 1 << 20
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _stretches(text: str, apart: re.Pattern) -> Iterator[str]:
    """The text in pieces that end at a place between two runs."""
    at = 0
    while at < len(text):
        cut = apart.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        stop = cut.start() if cut else len(text)
        yield text[at:stop] if at or cut else text
        at = stop


def _counter(length: int):
    runs, apart = re.compile(f"[{LETTERS}]{{{length},}}"), re.compile(f"[^{LETTERS}]")

    def sent(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = Counter(), 0
        for batch in slices(batches, "text"):
            for row, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = zlib.crc32(b":" if row is None else f"{row}:".encode())
                for piece in _stretches(text or "", apart):
                    for found, n in Counter(runs.findall(piece)).items():
                        word = found.translate(_LOWER)
                        h = zlib.crc32(word.encode(), start)
                        if h % DROPPED == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= length:
                            total[word] += n
                            size += len(word)
                if len(total) > COUNTED or size > CODE_POINTS:
                    yield sent(total)
                    total, size = Counter(), 0
        yield sent(total)

    return run


def words(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the runs of letters of all texts, A-Z lower-cased, with the dropped letters of the checksum.

    Counts are summed inside every task before the shuffle.
    """
    counted = docs.select("doc_id", "text").mapInArrow(_counter(length), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def window(s: int, j: int, level: int) -> tuple[int, int]:
    """The j-th of the 2**level windows of a word of s letters."""
    return s * j >> level, s * (j + 1) >> level


def _met(vocabulary: DataFrame, level: int) -> DataFrame:
    """(word, n, s, j, key): a row for each window in which a word of ``s`` letters and one of s or s + 1 can differ.

    ``vocabulary`` has also ``s`` and ``j``. ``key`` is a hash of what is outside the window.
    """
    a = F.floor(F.col("s") * F.col("j") / (1 << level)).cast("int")
    b = F.floor(F.col("s") * (F.col("j") + 1) / (1 << level)).cast("int")
    tail = b + F.length("word") - F.col("s") + 1
    outside = F.xxhash64("s", "j", F.substring("word", F.lit(1), a), F.substring("word", tail, F.length("word")))
    return vocabulary.filter(a < b).select("word", "n", "s", "j", outside.alias("key"))


class PositionIndex:
    """Bitsets of words by place and letter. Bit i stands for the i-th word; all have ``size`` or ``size + 1`` letters."""

    def __init__(self, held: list[str], size: int):
        self.size, self.short, self.every = size, 0, (1 << len(held)) - 1
        self.at: list[dict[str, int]] = [{} for _ in range(size + 1)]
        for i, word in enumerate(held):
            bit = 1 << i
            if len(word) == size:
                self.short |= bit
            for place, letter in zip(self.at, word, strict=False):
                place[letter] = place.get(letter, 0) | bit

    def near(self, word: str, last: bool = True) -> int:
        """The bitset of words one edit from ``word``, of which one is as long as the index says and the other no shorter.

        Unless ``last``, a letter too many at the very end does not count.
        """
        return self._near_short(word, last) if len(word) == self.size else self._near_long(word, last)

    def _near_short(self, word: str, last: bool) -> int:
        none, replaced, extra = self.every, 0, 0
        for i, letter in enumerate(word):
            here = self.at[i].get(letter, 0)
            after = self.at[i + 1].get(letter, 0)
            same = none & here
            replaced = replaced & here | none ^ same
            extra = (extra | none) & after
            none = same
        extra = extra | none if last else extra & ~none
        return replaced & self.short | extra & ~self.short

    def _near_long(self, word: str, last: bool) -> int:
        none, missing = self.short, 0
        for i, letter in enumerate(word):
            missing = (missing & self.at[i - 1].get(letter, 0) if i else 0) | none
            if i < self.size:
                none &= self.at[i].get(letter, 0)
        return missing if last else missing & ~none


def _matched(level: int):
    """Of rows sorted by key, for each word of a group that has near words there: (word, n_near, best), best by n and then word."""

    def found(group: list[tuple[str, int]], s: int, j: int) -> Iterator[tuple]:
        a, b = window(s, j, level)
        group.sort(key=lambda row: (-row[1], row[0]))
        inside = [word[a : b + len(word) - s] for word, _ in group]
        index = PositionIndex(inside, b - a)
        for (word, _), part in zip(group, inside, strict=True):
            if near := index.near(part, last=b == s):
                best = (near & -near).bit_length() - 1
                yield word, near.bit_count(), group[best][1], group[best][0]

    def of_key(rows: list[tuple]) -> Iterator[tuple]:
        # keys are hashes, so what is outside the window is compared too
        groups: dict[tuple, list[tuple[str, int]]] = {}
        for word, n, s, j in rows:
            a, b = window(s, j, level)
            groups.setdefault((s, j, word[:a], word[b + len(word) - s :]), []).append((word, n))
        for (s, j, _, _), group in groups.items():
            if len(group) > 1:
                yield from found(group, s, j)

    def sent(out: list[tuple]) -> pa.RecordBatch:
        kinds = {"word": pa.string(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "word", "n", "s", "j")]
            for key, *row in zip(*columns, strict=True):
                if key != at:
                    if len(held) > 1:
                        out.extend(of_key(held))
                    at, held = key, []
                held.append(row)
            if len(out) > 10_000:
                yield sent(out)
                out = []
        if len(held) > 1:
            out.extend(of_key(held))
        yield sent(out)

    return run


def near(vocabulary: DataFrame, length: int = LENGTH) -> DataFrame:
    """(word, n_near, best_n, best) of a table of distinct words (word, n), in parts: ``n_near`` adds up, the best of the bests counts.

    Two words are near if one inserted, deleted or replaced code point makes one the other. Every pair is found in one
    window of the shorter word: that where the two first differ. Keys that more than ``MEETING`` words have are counted
    before words are shuffled by them, and only halves of their windows are used; a window of one
    letter bounds a group by the letters there are.
    """
    shorter = F.array(F.length("word"), F.length("word") - 1)
    rows = vocabulary.select("word", "n", F.explode(shorter).alias("s")).filter(F.col("s") >= length)
    rows = rows.select("word", "n", "s", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    level, parts = 1, []
    while True:
        met = _met(rows, level)
        wide = F.floor(F.col("s") * (F.col("j") + 1) / (1 << level)) - F.floor(F.col("s") * F.col("j") / (1 << level)) > 1
        sizes = met.withColumn("wide", wide).groupBy("key").agg(F.count("*").alias("size"), F.max("wide").alias("wide"))
        sizes = save(sizes.filter("size > 1").select("key", (F.col("wide") & (F.col("size") > MEETING)).alias("large"), "size"), "spelling-keys")
        small, large = sizes.filter("not large").agg(F.sum("size")).first()[0] or 0, sizes.filter("large").select("key")
        again = save(met.join(large, "key", "left_semi").select("word", "n", "s", F.explode(F.array(F.col("j") * 2, F.col("j") * 2 + 1)).alias("j")), "spelling-rows")
        use = met.join(large, "key", "left_anti") if not again.isEmpty() else met
        use = use.repartition(small // ROWS + 1, "key").sortWithinPartitions("key")
        parts.append(use.mapInArrow(_matched(level), "word string, n_near bigint, best_n bigint, best string"))
        if again.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        rows, level = again, level + 1


def _best(n: Column, word: Column) -> Column:
    return F.min(F.when(word.isNotNull(), F.struct((-n).alias("back"), word.alias("word"))))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without cycles: the last of the forms that follow. Paths double with every round."""
    state = forms.select("word", F.col("form").alias("root"))
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = save(state.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        state = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return state


def variants(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word of the corpus with ``length`` code points and ``occurrences``.

    ``form`` is the near word with the largest n, of equal ones the first by code point, if it occurs ``ratio`` times as
    often as the word; ``root`` is where the forms end. Null and empty texts have no words; repeated rows
    count as often as they stand there; a null id is empty in the checksum; a table without words gives no row; other columns are not
    read. A run of letters of any length is a word like any other.
    """
    vocabulary = save(words(docs, length, occurrences), "vocabulary")
    none = vocabulary.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("best_n"), F.lit(None).cast("string").alias("best"))
    every = none.unionByName(near(vocabulary, length).withColumn("n", F.lit(None).cast("bigint")))
    rows = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), _best(F.col("best_n"), F.col("best")).alias("best"))
    often = -F.col("best.back") >= ratio * F.col("n")
    rows = save(rows.select("word", F.when(often, F.col("best.word")).alias("form"), "n", "n_near", F.when(often, -F.col("best.back")).alias("form_n")), "spelling-forms")
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
