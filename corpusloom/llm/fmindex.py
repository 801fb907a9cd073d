"""A compressed FM-index over a sequence of word numbers, searched for many patterns side by side."""

from __future__ import annotations

import numpy as np


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling from keys of several symbols."""
    n = len(sequence)
    bits = max(1, int(sequence.max()).bit_length()) if n else 1
    width = max(1, 62 // bits)
    padded = np.concatenate([sequence.astype(np.int64), np.zeros(width, np.int64)])
    key = padded[:n].copy()
    for step in range(1, width):
        key = (key << bits) | padded[step:step + n]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        if not n or rank[order[-1]] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[:max(0, n - width)] = rank[width:] + 1
        key, width = rank * (n + 1) + follow, width * 2


class WaveletMatrix:
    """Rank of any symbol up to any position, in one bit vector per bit of the symbols."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        n = len(sequence)
        for shift in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bit = (sequence >> shift) & 1
            packed = np.zeros((n // 64 + 2) * 8, np.uint8)
            raw = np.packbits(bit.astype(bool), bitorder="little")
            packed[:len(raw)] = raw
            blocks = packed.view(np.uint64)
            before = np.zeros(len(blocks), np.int64)
            np.cumsum(np.bitwise_count(blocks[:-1]), out=before[1:])
            self.levels.append((shift, blocks, before, n - int(before[-1])))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.first = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        for shift, blocks, before, zeros in self.levels:
            at = position >> 6
            below = (one << (position & 63).astype(np.uint64)) - one
            ones = before[at] + np.bitwise_count(blocks[at] & below)
            position = np.where((symbol >> shift) & 1, zeros + ones, position - ones)
        return position

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``position``."""
        return self._descend(symbol, position) - self.first[symbol]


class FMIndex:
    """Burrows-Wheeler transform in a wavelet matrix; the sequence must end with a unique 0."""

    def __init__(self, sequence: np.ndarray):
        symbols = int(sequence.max()) + 1
        self.order = suffix_array(sequence)
        self.matrix = WaveletMatrix(sequence[self.order - 1], symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])

    def repeats(self, sequence: np.ndarray, last: np.ndarray, length: int) \
            -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the patterns that end at the positions ``last``, up to ``length``.

        Every pattern is extended backwards as long as it has a second occurrence. Returns which
        patterns reach the whole length, and their ranges in the suffix order.
        """
        active = np.arange(len(last))
        symbol = sequence[last]
        low, high = self.below[symbol], self.below[symbol + 1]
        for step in range(1, length):
            open_ = high - low > 1
            active, low, high = active[open_], low[open_], high[open_]
            if not len(active):
                break
            symbol = sequence[last[active] - step]
            both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low = self.below[symbol] + both[:len(active)]
            high = self.below[symbol] + both[len(active):]
        open_ = high - low > 1
        return active[open_], low[open_], high[open_]

    def first_occurrence(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest text position in each range; equal-length patterns have equal or disjoint ranges."""
        starts, place = np.unique(low, return_inverse=True)
        stops = np.empty_like(starts)
        stops[place] = high
        edges = np.column_stack([starts, stops]).ravel()
        values = np.append(self.order, len(self.order))
        return np.minimum.reduceat(values, edges)[::2][place] if len(starts) else starts
