"""Vectorised text hashing for the search of long shared spans."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOW = np.uint64(0xFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points that start at each position, by prefix sums of a polynomial modulo 2**64."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(codes.astype(np.uint64) * up)])
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - k, _INVERSE)]))
    return mix((total[k:] - total[:-k]) * down)


class Prefixes:
    """Hashes of any stretch of one text, many at a time."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(codes.astype(np.uint64) * up[:n])])
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))

    def __len__(self) -> int:
        return len(self.total) - 1

    def of(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.total[start + n] - self.total[start]) * self.down[start]


def anchors(codes: np.ndarray, ends: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of texts laid end to end; ``ends`` holds each text's end.

    In every stretch of ``span`` code points within one text, the k-gram of
    the smallest hash (the leftmost of equal ones) is an anchor, so two texts
    with an equal stretch have an anchor in common inside it.
    """
    n, width = len(codes), span - k + 1
    h = gram_hashes(codes, k)
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = np.arange(len(h), dtype=np.uint64) & _LOW
    best, have = (h & ~_LOW) | low, 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: n - span + 1], best[width - have : width - have + n - span + 1])
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n - span + 2, np.int32)
    full = ends - starts >= span
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, ends[full] - span + 1, -1)
    first = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    at = first + ((best[first] - first.astype(np.uint64)) & _LOW).astype(np.int64)
    at = np.unique(at)
    return at, h[at]
