"""Minimal perfect hashing of whole numbers, by cascades of bit arrays (a published method).

A key alone at its place in the first array sets the bit there; keys that meet go on to the next,
smaller array. The number of set bits before a key's bit is its slot, so n keys have the slots 0 to n - 1. A
number that is no key may get a slot too; the keys, stored by slot, tell it apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from answerloom.llm.batches import mixed

#: Places in an array for each key that is left.
SPACE = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _places(keys: np.ndarray, level: int, words: int) -> np.ndarray:
    salt = mixed(np.array([level + 1], np.uint64) * _STEP)
    return (mixed(keys.view(np.uint64) ^ salt) % np.uint64(64 * words)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """``starts``: where each array begins, in words; ``bits``: all arrays; ``ranks``: bits set before each word; ``keys`` by slot."""

    starts: np.ndarray
    bits: np.ndarray
    ranks: np.ndarray
    keys: np.ndarray

    def slots(self, wanted: np.ndarray) -> np.ndarray:
        """The slot of each number of ``wanted`` (int64), or -1 where it is no key."""
        out = _slots(self.starts, self.bits, self.ranks, wanted)
        known = out >= 0
        known[known] = self.keys[out[known]] == wanted[known]
        return np.where(known, out, -1)


def _slots(starts: np.ndarray, bits: np.ndarray, ranks: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    out = np.full(len(wanted), -1, np.int64)
    left = np.arange(len(wanted))
    for level, (start, stop) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        place = _places(wanted[left], level, stop - start)
        word, bit = bits[start + (place >> 6)], (place & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
        out[left[hit]] = ranks[start + (place[hit] >> 6)] + np.bitwise_count(below)
        left = left[~hit]
    return out


def build(keys: np.ndarray) -> PerfectHash:
    """The hash of distinct int64 numbers."""
    left, arrays, starts = keys, [], [0]
    while len(left):
        words = -(-SPACE * len(left) // 64)
        place = _places(left, len(arrays), words)
        alone = np.bincount(place, minlength=64 * words) == 1
        arrays.append(np.packbits(alone, bitorder="little").view(np.uint64))
        starts.append(starts[-1] + words)
        left = left[~alone[place]]
    starts, bits = np.array(starts, np.int64), np.concatenate([*arrays, np.zeros(0, np.uint64)])
    ranks = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
    stored = np.empty(len(keys), np.int64)
    stored[_slots(starts, bits, ranks, keys)] = keys
    return PerfectHash(starts, bits, ranks, stored)
