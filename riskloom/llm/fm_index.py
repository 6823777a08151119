"""A compressed FM-index over integer sequences, with vectorised backward search.

The Burrows-Wheeler transform is kept in a wavelet matrix: one bit vector per binary
digit of the symbols, with a popcount sample per 64-bit word. Suffixes are ordered by
their first ``depth`` symbols only. That is enough: an interval of a pattern no longer
than ``depth`` begins where all smaller prefixes end, whatever the order among ties.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


class WaveletMatrix:
    """Rank over a sequence of small integers."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.n = len(values)
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        current = values.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.pad(packed, (0, 16 - len(packed) % 8)).view(np.uint64)
            counts = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            current = np.concatenate((current[~bit], current[bit]))
        every = np.arange(symbols)
        self.base = self._down(every, np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            word = place >> 6
            part = self.words[i][word] & ((ONE << (place & 63).astype(np.uint64)) - ONE)
            ones = self.before[i][word] + np.bitwise_count(part)
            up = (symbol >> (self.levels - 1 - i)) & 1 == 1
            place = np.where(up, self.zeros[i] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, place) - self.base[symbol]


class FMIndex:
    """``text`` holds symbols from 1; 0 closes every sequence, the last one too."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        self.n, self.depth = len(text), depth
        ranks, size = [text.astype(np.int64)], 1
        while size < depth:
            shifted = np.concatenate((ranks[-1][size:], np.zeros(min(size, self.n), np.int64)))[:self.n]
            key = ranks[-1] * (self.n + symbols + 1) + shifted
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank = np.empty(self.n, np.int64)
            rank[order] = new
            ranks.append(rank + 1)
            size *= 2
        self.rows = order if size > 1 else np.argsort(text, kind="stable")
        self.ranks = ranks
        self.start = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.wavelet = WaveletMatrix(text[self.rows - 1], symbols)

    def runs(self, length: int) -> np.ndarray:
        """True at each row whose first ``length`` symbols differ from the row above."""
        new = np.zeros(self.n, bool)
        new[0] = True
        done = 0
        for power in range(len(self.ranks) - 1, -1, -1):
            if length - done >= 1 << power:
                place = self.rows + done
                value = np.where(place < self.n, self.ranks[power][np.minimum(place, self.n - 1)], 0)
                new[1:] |= value[1:] != value[:-1]
                done += 1 << power
        return new

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals of the patterns with ``symbol`` put in front."""
        first = self.start[symbol]
        return first + self.wavelet.rank(symbol, low), first + self.wavelet.rank(symbol, high)


def matching_windows(index: FMIndex, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray, window: int):
    """Rows at which each window's interval begins, for sequences streamed over the index.

    All sequences go from right to left side by side. A match grows by one symbol; once
    it has ``window`` symbols it is reported and cut back by one at its right end, to the
    run of rows that agree in ``window - 1`` symbols. Yields (sequence, window, low, high).
    """
    new = index.runs(window - 1)
    heads = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    tails = np.append(heads[1:], index.n)
    order = np.argsort(-lengths, kind="stable")
    low, high = np.zeros(len(order), np.int64), np.full(len(order), index.n, np.int64)
    for step in range(1, int(lengths.max(initial=0)) + 1):
        active = int(np.searchsorted(-lengths[order], -step, side="right"))
        who = order[:active]
        low, high = low[:active], high[:active]
        symbol = text[begins[who] + lengths[who] - step]
        low, high = index.extend(symbol, low, high)
        if step >= window:
            yield who, lengths[who] - step, low, high
            at = run[low]
            low, high = heads[at], tails[at]
