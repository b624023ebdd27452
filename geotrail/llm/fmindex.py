"""A compressed full-text index over words: BWT in a wavelet matrix, searched backwards.

Works on one shard of bounded size; all patterns advance together, one word a step.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector, packed, with the ones before each block of 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        block = i >> 6
        part = self.words[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(part)


class WaveletMatrix:
    """Occurrences of a symbol before a place, for many symbols and places at once."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.depth = max(1, int(kinds - 1).bit_length())
        self.levels = []
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.levels.append(BitRank(bits))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.first = self._walk(np.arange(kinds), np.zeros(kinds, np.int64))

    def _walk(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = bits.ones(i)
            i = np.where((symbols >> level) & 1, bits.zeros + ones, i - ones)
        return i

    def count(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(symbols, i) - self.first[symbols]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes, ordered by their first ``depth`` symbols at least."""
    rank, known, n = text.astype(np.int64), 1, len(text)
    order = np.argsort(rank, kind="stable")
    while known < depth:
        key = rank * (n + 2)
        key[: n - known] += rank[known:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        known *= 2
    return order


class FMIndex:
    """Index of a text of symbols 1 .. ``kinds`` - 1; 0 separates its parts."""

    def __init__(self, text: np.ndarray, kinds: int, depth: int):
        self.order = suffix_array(text, depth)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])
        self.matrix = WaveletMatrix(text[self.order - 1], kinds)

    def matches(self, text: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics up to the threshold, for patterns of a text that end at ``ends``.

        Returns how far back each pattern was followed, and the interval of the suffixes
        that match there. A pattern is left alone once it occurs at one place only.
        """
        symbols = text[ends]
        low, high = self.starts[symbols].copy(), self.starts[symbols + 1].copy()
        length = np.ones(len(ends), np.int64)
        alive = np.flatnonzero(high - low > 1)
        for step in range(1, threshold):
            symbols = text[ends[alive] - step]
            base = self.starts[symbols]
            low[alive] = base + self.matrix.count(symbols, low[alive])
            high[alive] = base + self.matrix.count(symbols, high[alive])
            length[alive] += 1
            alive = alive[high[alive] - low[alive] > 1]
        return length, low, high
