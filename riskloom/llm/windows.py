"""Fixed-length windows over token streams, cut into runs that share an anchor.

Two windows of equal content have equal minima over the hashes of their k-grams. A
maximal run of neighbouring windows with one minimum is a *segment*; the minimum is its
*anchor*. Equal windows therefore always lie in segments of equal anchor, so segments
can be dealt out by anchor and compared group by group. About ``2 / (window - k + 2)``
segments arise per token, which keeps the exchange far below one row per window.
"""

from __future__ import annotations

import numpy as np
import xxhash

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: The low bits of a k-gram's value give way to its place, so a minimum tells where it stands.
PLACE = np.uint64(2047)
#: Windows in one segment at most; longer runs (periodic text) are cut, which only adds segments.
LONGEST = 1024


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to ``keep`` words."""

    def __init__(self, keep: int = 500_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k``-grams, by doubling; ``units`` are 64-bit hashes of the tokens."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, size = None, 0, units, 1
    left = k
    while left:
        if left & 1:
            part = power[done:done + n]
            out = part.copy() if out is None else mixed(out * np.uint64(0x9E3779B97F4A7C15) + part)
            done += size
        left >>= 1
        if left:
            power = power[:-size] * np.uint64(0xC2B2AE3D27D4EB4F) + power[size:]
            power ^= power >> np.uint64(31)
            size *= 2
    return mixed(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all stretches of ``w`` values, in time independent of ``w``."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    if w == 1:
        return x.copy()
    rows = -(-len(x) // w)
    padded = np.full(rows * w, TOP, np.uint64)
    padded[:len(x)] = x
    table = padded.reshape(rows, w)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1:w - 1 + n])


def segments(units: np.ndarray, bounds: np.ndarray, window: int, k: int):
    """Segments of the documents laid end to end in ``units``.

    ``bounds`` holds the start of each document and the total length; ``window - k`` is
    below 2048. Returns arrays (document, first window's start, number of windows,
    anchor, repeats), where ``repeats`` says that the anchor stands at more than one
    place in the segment: only then can a segment hold a window twice.
    """
    empty = np.empty(0, np.int64)
    width = window - k + 1
    values = gram_hashes(units, k) & ~PLACE
    n = len(values) - width + 1
    if n <= 0:
        return empty, empty, empty, np.empty(0, np.uint64), np.empty(0, bool)
    place = np.arange(len(values), dtype=np.uint64) & PLACE
    early = sliding_min(values | place, width)
    lengths = np.diff(bounds)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[:n]
    inside = np.arange(window, window + n) <= bounds[1:][owner]
    low = early & ~PLACE
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[1:] |= (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    keep = inside[starts]
    starts, ends = starts[keep], ends[keep]
    if len(starts) and (ends - starts).max() > LONGEST:
        counts = -(-(ends - starts) // LONGEST)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        first = np.repeat(starts, counts) + step * LONGEST
        ends = np.minimum(first + LONGEST, np.repeat(ends, counts))
        starts = first
    late = sliding_min(values | (PLACE - place), width)
    one = early[starts]
    repeats = (one != early[ends - 1]) | ((one & PLACE) + (late[starts] & PLACE) != PLACE) \
        | ((one & PLACE) + (late[ends - 1] & PLACE) != PLACE)
    return owner[starts].astype(np.int64), starts - bounds[owner[starts]], ends - starts, low[starts], repeats


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(n: int, starts, ends) -> np.ndarray:
    """Which of ``n`` places lie in any of the half-open stretches."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.asarray(starts, np.int64), 1)
    np.add.at(change, np.asarray(ends, np.int64), -1)
    return np.cumsum(change[:n]) > 0
