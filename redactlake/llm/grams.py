"""Sampled positions of byte strings and their hashed ranks, in numpy.

A rank of the substring at a position is its polynomial hash modulo 2**64, taken
from prefix sums, so equal substrings have equal ranks in every task without any
sort. Of the grams inside each window one is its anchor: the gram with the lowest
mixed rank, leftmost on ties. Equal windows have their anchor at the same place.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240501)
_VALUES = [_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers = [(np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)) for _ in _BASES]


def powers(n: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[kind][0]) < n:
        n = 1 << (n - 1).bit_length()
        steps = [np.full(n, x, dtype=np.uint64) for x in (_BASES[kind], pow(_BASES[kind], -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        _powers[kind] = tuple(np.cumprod(s, dtype=np.uint64) for s in steps)
    return _powers[kind]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Ranks:
    """Ranks of all substrings of some bytes; those of the two kinds are independent."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        up, self.down = powers(len(data) + 1, kind)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[kind][data] * up[: len(data)], out=self.sums[1:])

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed ranks of the substrings [begin, end)."""
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def every(self, size: int) -> np.ndarray:
        """Mixed ranks of all substrings of one size, by position."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


def lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(ranks: Ranks, sizes: np.ndarray, window: int, gram: int):
    """Runs of windows with one anchor in documents that lie one after another.

    Returns (anchor, first window, last window, document) of each run, positions in
    the whole; windows never reach over two documents.
    """
    g = ranks.every(gram)
    width = window - gram + 1
    if len(g) < width:
        return (np.zeros(0, dtype=np.int64),) * 4
    # High bits of the rank, then the position: leftmost on ties.
    bits = np.uint64(max(1, int(len(g)).bit_length()))
    key = ((g >> bits) << bits) | np.arange(len(g), dtype=np.uint64)
    at = (lowest(key, width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    end = np.cumsum(sizes)
    # Windows of each document: all starts but its last window - 1.
    count = np.maximum(sizes - window + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), count)
    p = np.arange(count.sum()) + np.repeat(end - sizes - (np.cumsum(count) - count), count)
    if not len(p):
        return (np.zeros(0, dtype=np.int64),) * 4
    a = at[p]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
    tail = np.append(head[1:], len(p)) - 1
    return a[head], p[head], p[tail], doc[head]
