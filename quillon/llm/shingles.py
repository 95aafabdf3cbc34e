"""Words and word shingles of many texts at once, as 64-bit hashes, from their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_RNG = np.random.default_rng(20240101)
# A random odd 64-bit number per byte; letters A-Z share the number of their lower case, white space has none.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, made once per process for the longest need so far."""
    if len(_POWERS[0]) < n:
        for i, b in enumerate((BASE, INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts that lie end to end in ``data``, A-Z folded to lower case.

    Returns their hashes, their first and past-the-last byte, and where each text's words begin (one more than texts).
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    edge[1:n] = False
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    last = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE[data] * up, out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return hashes, first, last, np.searchsorted(first, offsets)


def shingles(hashes: np.ndarray, starts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within each text (the whole text as one run if it is shorter), and where each text's begin."""
    counts = np.diff(starts)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(made)])
    total = int(begin[-1])
    if not total:
        return np.zeros(0, np.uint64), begin
    at = np.arange(total) + np.repeat(starts[:-1] - begin[:-1], made)
    length = np.repeat(np.minimum(counts, k), made)
    acc = length.astype(np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        step = padded[at + j]
        acc = np.where(j < length, (acc ^ step) * BASE + (step >> np.uint64(32)), acc)
    return mix(acc), begin


def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each text sorted and without repeats, and where each text's begin."""
    n = len(begin) - 1
    if not len(values):
        return values, np.zeros(n + 1, np.int64)
    text = np.repeat(np.arange(n), np.diff(begin))
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    v, t = v[new], t[new]
    return v, np.searchsorted(t, np.arange(n + 1))


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Intersection and union size of two sorted arrays without repeats."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common, len(a) + len(b) - common
