"""Longest common subsequence and word stems, Arrow-batched."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose tokens are stemmed together, and stems that a worker keeps.
STEMMED_ROWS, STEMS = 1 << 11, 1 << 18
#: Items times distinct items of the longer side whose places are held as bits, at most.
BITS = 1 << 28
#: Tokens of both sides whose runs are counted together, about; a longer row is counted whole.
COUNTED = 1 << 18
STEMMED_SIDES = T.StructType().add("left", T.ArrayType(T.StringType())).add("right", T.ArrayType(T.StringType())).add("common", T.LongType()).add("words", T.LongType())
SHARED_RUNS = T.StructType().add("shared", T.ArrayType(T.LongType())).add("left", T.LongType()).add("right", T.LongType())


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence.

    The longer side is held as the bits of one integer, so each item of the shorter one costs a few integer operations. Shared ends are
    cut first: they always belong to a longest subsequence. Then items go that the other side does not have.
    """
    long, short = _numbers(a, b)
    if len(long) < len(short):
        long, short = short, long
    low = _equal(long, short)
    long, short = long[low:], short[low:]
    high = _equal(long[::-1], short[::-1])
    long, short, shared = long[: len(long) - high], short[: len(short) - high], low + high
    known, long = _places(long, np.unique(short))
    present, short = _places(short, known[np.unique(long)])
    long = np.searchsorted(present, known[long])
    if len(long) * len(present) > BITS:  # the shorter side's bits are fewer
        long, short = sorted((long, short), key=len)
    if not len(short):
        return shared

    width = len(long)
    n_bytes = -(-width // 8)
    bits, position = np.zeros(len(present) * n_bytes, np.uint8), np.arange(width)
    np.add.at(bits, long * n_bytes + position // 8, (1 << position % 8).astype(np.uint8))
    places = [int.from_bytes(row.tobytes(), "little") for row in bits.reshape(-1, n_bytes)]
    mask = (1 << width) - 1
    unmatched = mask
    for item in short.tolist():
        hits = unmatched & places[item]
        unmatched = ((unmatched + hits) | (unmatched - hits)) & mask
    return shared + width - unmatched.bit_count()


def _numbers(a: Sequence, b: Sequence) -> list[np.ndarray]:
    """Both sides as numbers, equal where the items are."""
    if isinstance(a, np.ndarray):
        return [a, b]
    if isinstance(a, str):
        return [np.frombuffer(side.encode("utf-32-le", "surrogatepass"), np.uint32) for side in (a, b)]
    number: dict = {}
    return [np.array([number.setdefault(item, len(number)) for item in side], np.int64) for side in (a, b)]


def _equal(long: np.ndarray, short: np.ndarray) -> int:
    """How many items are equal from the beginning on."""
    differ = np.flatnonzero(long[: len(short)] != short)
    return int(differ[0]) if len(differ) else len(short)


def _places(items: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``known``, in order, and for each item that is there its place in it."""
    place = np.searchsorted(known, items)
    place[place == len(known)] = 0
    return known, place[known[place] == items] if len(known) else place[:0]


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


@F.arrow_udf(T.LongType())
def lcs_of_arrays(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in batches:
        yield _lcs_lengths(left, right)


def _lcs_lengths(*sides: pa.Array) -> pa.Array:
    """Items are compared by their numbers in the batch."""
    flat = [side.flatten() for side in sides]
    codes = pa.concat_arrays(flat).dictionary_encode(null_encoding="encode").indices.to_numpy()
    left, right = codes[: len(flat[0])], codes[len(flat[0]) :]
    lengths, low_a, low_b = [], 0, 0
    for high_a, high_b in zip(*(np.cumsum(_sizes(side)).tolist() for side in sides)):
        lengths.append(lcs_length(left[low_a:high_a], right[low_b:high_b]))
        low_a, low_b = high_a, high_b
    return pa.array(lengths, pa.int64())


def shared_runs(order: int):
    """A function of two arrays of tokens: how many runs of 1, 2, ... ``order`` tokens they share, equals paired off, and their sizes."""

    @F.arrow_udf(SHARED_RUNS)
    def shared(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sides in batches:
            tokens = np.cumsum(sum(map(_sizes, sides)))
            cuts = np.flatnonzero(np.diff(tokens // COUNTED, prepend=0)).tolist()
            steps = zip([0, *cuts], [*cuts, len(tokens)])
            made = [_shared_runs([side.slice(low, high - low) for side in sides], order) for low, high in steps if low < high]
            yield pa.concat_arrays(made) if made else _shared_runs(sides, order)

    return shared


def _shared_runs(sides: Sequence[pa.Array], order: int) -> pa.Array:
    flat, sizes = [side.flatten() for side in sides], [_sizes(side) for side in sides]
    codes = pa.concat_arrays(flat).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    ends = np.concatenate([np.cumsum(sizes[0]), len(flat[0]) + np.cumsum(sizes[1])])
    rest = np.repeat(ends, np.concatenate(sizes)) - np.arange(len(codes))
    row = np.repeat(np.tile(np.arange(len(sides[0])), 2), np.concatenate(sizes))
    found, n_codes = np.zeros((len(sides[0]), order), np.int64), codes.max(initial=0) + 1
    at, before = np.arange(len(codes)), row
    for n in range(order):
        # equal numbers: the same run in the same row
        _, first, run = np.unique(before * n_codes + codes[at + n], return_index=True, return_inverse=True)
        counts = [np.bincount(run[own], minlength=len(first)) for own in (at < len(flat[0]), at >= len(flat[0]))]
        both = np.minimum(*counts)
        found[:, n] = np.bincount(row[at[first]], both, minlength=len(found))
        # a longer run that both have begins with one that both have
        longer = (both[run] > 0) & (rest[at] > n + 1)
        at, before = at[longer], run[longer]
    lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), order).cast(pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([lists, *(pa.array(n, pa.int64()) for n in sizes)], ["shared", "left", "right"])


@F.pandas_udf(T.LongType())
def lcs_of_texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([lcs_length(a, b) for a, b in zip(left, right)], dtype="int64")


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stem the tokens longer than three characters. Only the distinct ones of some rows at a time become Python objects."""
    for batch in batches:
        yield pa.concat_arrays([_stemmed(batch.slice(low, STEMMED_ROWS)) for low in range(0, max(1, len(batch)), STEMMED_ROWS)])


@F.arrow_udf(STEMMED_SIDES)
def stemmed_sides(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Both arrays stemmed, the length of their longest common subsequence, and how many words they share: all in one worker of a task."""
    for sides in batches:
        made = []
        for low in range(0, max(1, len(sides[0])), STEMMED_ROWS):
            both = [_stemmed(side.slice(low, STEMMED_ROWS)) for side in sides]
            words = _shared_runs(both, 1).field("shared").flatten()
            made.append(pa.StructArray.from_arrays([*both, _lcs_lengths(*both), words], ["left", "right", "common", "words"]))
        yield pa.concat_arrays(made)


def _stemmed(lists: pa.Array) -> pa.Array:
    tokens = lists.flatten().dictionary_encode()
    stems = pa.array([stem(t) if len(t) > 3 else t for t in tokens.dictionary.to_pylist()], pa.string())
    offsets = pa.array(np.concatenate([[0], np.cumsum(_sizes(lists))]), pa.int32())
    return pa.ListArray.from_arrays(offsets, stems.take(tokens.indices), mask=lists.is_null())


# The suffix tables of the published Porter algorithm, with the
# later additions alli, fulli, logi and bli, and the irregular forms.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
).split()


class _Kinds(dict):
    """A table for ``str.translate``: vowels, y, and all else as a consonant."""

    def __missing__(self, letter: int) -> str:
        return "c"


KINDS = _Kinds({ord(letter): "v" for letter in "aeiou"} | {ord("y"): "y"})


def _shape(word: str) -> str:
    """The word as consonants and vowels; y is a vowel after a consonant."""
    shape = word.translate(KINDS)
    while (at := shape.find("y")) >= 0:
        shape = shape[:at] + ("v" if shape[:at].endswith("c") else "c") + shape[at + 1 :]
    return shape


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _ends_short(word: str) -> bool:
    shape = _shape(word)
    if shape.endswith("cvc") and word[-1] not in "wxy":
        return True
    return shape == "vc"


def _ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _by_last_letter(suffixes) -> dict[str, list[str]]:
    """The suffixes by their last letter, the longest first."""
    longest_first = sorted(suffixes, key=len, reverse=True)
    return {last: [s for s in longest_first if s[-1] == last] for last in {s[-1] for s in suffixes}}


ENDINGS, ENDINGS_2, ENDINGS_3, ENDINGS_4 = map(_by_last_letter, (("ed", "ing"), STEP_2, STEP_3, STEP_4))


def _longest(word: str, endings: dict[str, list[str]]) -> str | None:
    for suffix in endings.get(word[-1:], ()):
        if word.endswith(suffix):
            return suffix
    return None


@lru_cache(maxsize=STEMS)
def stem(word: str) -> str:
    """Porter stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        suffix = _longest(word, ENDINGS)
        if suffix and "v" in _shape(word[: -len(suffix)]):
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _ends_double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _ends_short(word):
                word += "e"

    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        word = word[:-1] + "i"

    suffix = _longest(word, ENDINGS_2)
    if suffix == "alli" and _measure(word[:-4]) > 0:
        return _last_steps(_step_2(word[:-2]))
    return _last_steps(_step_2(word))


def _step_2(word: str) -> str:
    suffix = _longest(word, ENDINGS_2)
    if suffix:
        kept = word[: -len(suffix)]
        measured = word[:-3] if suffix == "logi" else kept
        if _measure(measured) > 0:
            return kept + STEP_2[suffix]
    return word


def _last_steps(word: str) -> str:
    suffix = _longest(word, ENDINGS_3)
    if suffix and _measure(word[: -len(suffix)]) > 0:
        word = word[: -len(suffix)] + STEP_3[suffix]

    suffix = _longest(word, ENDINGS_4)
    if suffix:
        kept = word[: -len(suffix)]
        if _measure(kept) > 1 and (suffix != "ion" or kept[-1] in "st"):
            word = kept

    if word.endswith("e"):
        kept = word[:-1]
        measure = _measure(kept)
        if measure > 1 or (measure == 1 and not _ends_short(kept)):
            word = kept
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
