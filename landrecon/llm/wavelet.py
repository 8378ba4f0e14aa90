"""A wavelet matrix over a sequence of small classes, all of whose queries work on whole numpy arrays.

Each level holds one bit of every class in the order the levels above have left, zeros before ones. Bits
are packed to words with running counts, so a rank costs one look at each level, and a select a bisection
of the counts at each level.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Bits:
    """A bit vector with counts of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self, value: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one (or zero), counted from 0."""
        before = self.before if value else 64 * np.arange(len(self.before)) - self.before
        word = np.searchsorted(before, k, "right") - 1
        held = self.words[word] if value else ~self.words[word]
        spread = np.unpackbits(held.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        seen = np.cumsum(spread, axis=1, dtype=np.int64)
        return 64 * word + (seen > (k - before[word])[:, None]).argmax(1)


class WaveletMatrix:
    """Rank and select over ``classes``, numbers below 2**levels."""

    def __init__(self, classes: np.ndarray, levels: int):
        self.size, self.levels, self.bits = len(classes), levels, []
        now = classes
        for level in reversed(range(levels)):
            ones = (now >> level & 1).astype(bool)
            self.bits.append(Bits(ones))
            now = np.concatenate([now[~ones], now[ones]])

    def _down(self, value: int, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(reversed(range(self.levels)), self.bits):
            ones = bits.rank(at)
            at = self.size - bits.ones + ones if value >> level & 1 else at - ones
        return at

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """Elements of class ``value`` before each position."""
        return self._down(value, at) - self._down(value, np.zeros(1, np.int64))

    def ranks(self, values: Sequence[int], at: np.ndarray) -> np.ndarray:
        """Elements of any of the classes before each position: the sum of their ranks."""
        return sum((self.rank(v, at) for v in values), np.zeros(len(at), np.int64))

    def select(self, value: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th element of class ``value``, counted from 0. It must exist."""
        at = self._down(value, np.zeros(1, np.int64)) + k
        for level, bits in zip(range(self.levels), reversed(self.bits)):
            at = bits.select(1, at - (self.size - bits.ones)) if value >> level & 1 else bits.select(0, at)
        return at

    def selects(self, values: Sequence[int], k: np.ndarray) -> np.ndarray:
        """Position of the k-th element of any of the classes: a select for one class, else a bisection on the summed ranks."""
        if len(values) == 1:
            return self.select(values[0], k)
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.size, np.int64)
        for _ in range(int(self.size).bit_length() + 1):
            middle = (low + high) >> 1
            enough = self.ranks(values, np.minimum(middle + 1, self.size)) > k
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return high
