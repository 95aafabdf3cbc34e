"""SetSketch registers: exponentially spaced, truncated minima of a set's hashes, and what they tell about two sets."""

from __future__ import annotations

import numpy as np

BASE = 1.001
RATE = 1e10
TOP = 65534
# Registers of one value hash alike: the multiplier and increment of each register are drawn once.
_RNG = np.random.default_rng(5)
MULTIPLIERS = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
INCREMENTS = _RNG.integers(0, 2**63, 4096, dtype=np.uint64)
STEP = 1 << 15


def registers(values: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """m registers per set; a set's values lie at begin[i]:begin[i+1], repeats do no harm, an empty set has zeros.

    Register i of a set is floor(1 - log_b(x_i)), held to 0..q+1, where x_i is the least of the exponential hashes
    (rate a) of the set's values: the larger of two sets' registers is the register of their union.
    """
    n = len(begin) - 1
    low = np.full((n, m), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        for s in range(0, len(values), STEP):
            e = min(len(values), s + STEP)
            a = np.searchsorted(begin, s, side="right") - 1
            b = np.searchsorted(begin, e, side="left")
            rows = np.arange(a, b)
            rows = rows[begin[rows + 1] > np.maximum(begin[rows], s)]
            cuts = np.maximum(begin[rows], s) - s
            part = values[s:e]
            for i in range(m):
                h = ((part * MULTIPLIERS[i] + INCREMENTS[i]) >> np.uint64(32)).astype(np.uint32)
                low[rows, i] = np.minimum(low[rows, i], np.minimum.reduceat(h, cuts))
    x = -np.log1p(-(low.astype(float) + 0.5) / 2.0**32) / RATE
    out = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)
    out[np.diff(begin) == 0] = 0
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


GRID = np.linspace(0.0, 1.0, 101)


def likelihood_jaccard(larger: np.ndarray, smaller: np.ndarray, m: int, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs (u, v), to 0.01.

    ``larger`` and ``smaller`` count the registers in which u's value is above or below v's; nu and nv are the set
    sizes. With shares u, v of the sizes and similarity J, a register of u is larger with probability p(u - v J).
    """
    su, sv = nu / np.maximum(nu + nv, 1), nv / np.maximum(nu + nv, 1)
    best, arg = np.full(len(su), -np.inf), np.zeros(len(su))
    tiny = 1e-12
    equal = m - larger - smaller
    for j in GRID:
        up, down = _p(su - sv * j), _p(sv - su * j)
        same = np.clip(1 - up - down, 0, 1)
        ll = larger * np.log(np.maximum(up, tiny)) + smaller * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(same, tiny))
        ll[(su < sv * j - 1e-9) | (sv < su * j - 1e-9)] = -np.inf
        better = ll > best
        best[better], arg[better] = ll[better], j
    return arg


def compare(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Estimated similarity of a[i] and b[i] for rows of registers."""
    return likelihood_jaccard((a > b).sum(axis=1), (a < b).sum(axis=1), a.shape[1], na, nb)


def bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band of ``rows`` registers; the band's number is part of the key."""
    from quillon.llm.shingles import mix

    n, m = regs.shape
    out = np.zeros((n, m // rows), np.uint64)
    for b in range(m // rows):
        acc = np.full(n, np.uint64(b + 1))
        for k in range(rows):
            acc = mix(acc ^ (regs[:, b * rows + k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        out[:, b] = acc
    return out


def tune(threshold: float, miss: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows per band): the most selective bands that miss a pair at the threshold with chance ``miss`` at most."""
    for rows in range(8, 0, -1):
        need = int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows))))
        if need * rows <= most:
            return need, rows
    return int(np.ceil(np.log(miss) / np.log1p(-threshold))), 1
