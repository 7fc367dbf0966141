"""Words and shingles of many texts at once, in numpy over the texts' bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_BACK = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^ \\t-\\r]+ and, for each text, the offset of its first word among them."""
    inside = ~_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside & (np.r_[True, ~inside[:-1]] | edge[:-1])
    end = inside & (np.r_[~inside[1:], True] | edge[1:])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, in runs of spans over about ``most`` bytes. starts must ascend."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(starts // most) > 0]), len(starts)]
    return np.concatenate([_hashes(data, starts[a:b], ends[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, from 0 to n - 1."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, _BACK))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    low, high = int(starts[0]), int(ends.max())
    data, starts, ends = data[low:high], starts - low, ends - low
    power, back = _powers(1 << max(20, len(data).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64, out=sums[1:])
        out = (sums[ends] - sums[starts]) * back[starts]  # wherever the span lies
        return mix(out + (ends - starts).astype(np.uint64) * _MIX)


def shingles(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and the offsets of the texts' runs. A text of fewer words has one run
    of them all, one without words none."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first[:-1], count)
    left = np.repeat(first[1:], count)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            here = at + j
            ok = here < left
            out[ok] = (out[ok] * np.uint64(0x2127599BF4325C37)) ^ mix(word[here[ok]] + np.uint64(j))
    return mix(out), offsets
