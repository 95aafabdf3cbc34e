"""Angle scans by counts and bounds against the full grids in NumPy."""

import math

import numpy as np
import pytest

from quillon.operators import features


def plane(rng, n, angle):
    x = np.r_[rng.normal(0, 1, (n, 2)), np.column_stack([rng.normal(0, 0.05, n // 2) + 0.7, rng.normal(0, 2, n // 2)]), np.zeros((5, 2))]
    c, s = math.cos(angle), math.sin(angle)
    return x @ np.array([[c, s], [-s, c]])


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(12)
    return {0: plane(rng, 300, 0.4), 3: plane(rng, 90, 2.1), 7: np.round(plane(rng, 200, 1.0), 1)}


@pytest.fixture(scope="module")
def pairs(spark, clusters):
    rows = [(c, i, float(a), float(b)) for c, x in clusters.items() for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "cluster int, id long, x double, y double").repartition(5)


def brute_separability(x, n_angles=1000, bins=40, clip=3.0):
    best = np.inf
    for a in range(n_angles):
        th = a * (math.pi / n_angles)
        u, v = x[:, 0] * math.cos(th) + x[:, 1] * math.sin(th), x[:, 1] * math.cos(th) - x[:, 0] * math.sin(th)
        ok = (abs(u) < clip) & (abs(v) < clip)
        iu, iv = (np.clip(((c[ok] + clip) / (2 * clip) * bins).astype(int), 0, bins - 1) for c in (u, v))
        h = np.zeros((bins, bins))
        np.add.at(h, (iu, iv), 1)
        p = h / h.sum()
        e = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
        best = min(best, (p[p > 0] * np.log2(p[p > 0] / e[p > 0])).sum())
    return best


def brute_mixture(x, eps=0.1, n_phi=360, n_offsets=61, refine=(40, 121)):
    def share(phi, offsets):
        p = x[:, 0] * math.cos(phi) + x[:, 1] * math.sin(phi)
        q = np.quantile(p, [0.005 + 0.99 * i / (offsets - 1) for i in range(offsets)])
        return (np.abs(p[:, None] - q) < eps * np.sqrt(p.var(ddof=1) + (p.mean() - q) ** 2)).mean(0).max()

    step = math.pi / n_phi
    first = [(share(i * step, n_offsets), i * step) for i in range(n_phi)]
    m, at = max(first)
    return max(m, max(share(at - step + i * (2 * step / (refine[0] - 1)), refine[1]) for i in range(refine[0])))


def test_separability_is_that_of_all_angles(pairs, clusters):
    got = {r["cluster"]: r["separability"] for r in features.separability(pairs).collect()}
    assert got.keys() == clusters.keys() and all(np.isclose(got[c], brute_separability(x)) for c, x in clusters.items())


def test_mixture_is_that_of_the_full_grids(pairs, clusters):
    got = {r["cluster"]: r["mixture"] for r in features.mixture_index(pairs).collect()}
    assert got.keys() == clusters.keys() and all(np.isclose(got[c], brute_mixture(x)) for c, x in clusters.items())


def test_bounds_enclose_every_share_and_leave_few_bands_open(pairs, clusters):
    open_ = features._open_bands(pairs.withColumn("from", features.F.lit(0.0)), "from", math.pi / 360, 360, 0.1, 61)
    assert 0 < open_.where("cluster = 0").count() < 360 * 61 / 50
