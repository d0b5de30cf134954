"""Minimal perfect hashing of sets of 64-bit keys, all in numpy arrays.

Keys are hashed to twice as many places as there are keys; those that have their place to
themselves keep it, the others go on to the next level, until none is left. A key's
number is the rank of its place among the kept places of all levels, so n keys have the
numbers 0 to n-1. About 0.6 bytes a key, ranks included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sieveworks.llm.bytetext import mixed

#: Places for each key of a level.
ROOM = 2
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(keys.astype(np.uint64) + _SEED * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """Kept places of all levels, 64 to a word, and how many lie before each word."""

    sizes: tuple[int, ...]
    words: np.ndarray
    ranks: np.ndarray
    count: int

    @staticmethod
    def of(keys: np.ndarray) -> PerfectHash:
        """The hash of distinct keys."""
        rest, sizes, words = keys, [], []
        while len(rest):
            size = (ROOM * len(rest) + 63) // 64 * 64
            at = _places(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = rest[~alone[at]]
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(flat), dtype=np.int64)])[:-1].astype(np.uint32)
        return PerfectHash(tuple(sizes), flat, ranks, len(keys))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; one outside the set gets -1 or the number of some key, so callers compare keys."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _places(keys[left], level, size)
            word = base + at // 64
            bit = np.uint64(1) << (at % 64).astype(np.uint64)
            there = (self.words[word] & bit) != 0
            mine = word[there]
            out[left[there]] = self.ranks[mine] + np.bitwise_count(self.words[mine] & (bit[there] - np.uint64(1)))
            left, base = left[~there], base + size // 64
        return out
