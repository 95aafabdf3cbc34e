"""Named nulls and scans against plain loops."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import probes as L, shifts, vector_stats as V


def loop_null(normals, q, lam, n, rho, si, sj):
    """The null in the original basis, one draw after the other."""
    deg = lambda c: float(np.degrees(np.arccos(np.clip(c, -1, 1))))
    root, out = (q * np.sqrt(lam / n)) @ q.T, []
    for g1, g2, z1, z2 in normals:
        g = np.linalg.qr(np.column_stack([q @ g1, q @ g2]))[0] * np.sign(np.diag(np.linalg.qr(np.column_stack([q @ g1, q @ g2]))[1]))
        pair = np.column_stack([g[:, 0], rho * g[:, 0] + math.sqrt(1 - rho * rho) * g[:, 1]])
        w = []
        for c, z, s in zip(pair.T, (q @ z1, q @ z2), (si, sj)):
            xy = n * math.sqrt(s) * (root @ c) + math.sqrt(n * (1 - s)) * (root @ z)
            v = q @ ((q.T @ xy) / (lam + L.ALPHA_DIRECTION))
            w.append(v / np.linalg.norm(v))
        out.append(deg(w[0] @ w[1]) - deg(rho))
    return out


def test_null_angles_match_the_loop():
    rng = np.random.default_rng(1)
    q, lam = np.linalg.qr(rng.standard_normal((6, 6)))[0], rng.exponential(300, 6)
    normals = rng.standard_normal((9, 4, 6))
    for rho in (0.0, 0.7, -0.9):
        got = shifts.null_angles(normals, lam, 500.0, np.full(9, rho), np.full(9, 0.6), np.full(9, 0.2))
        assert np.allclose(got, loop_null(normals, q, lam, 500.0, rho, 0.6, 0.2))


def test_angle_null_draws_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 5))
    y = x @ rng.standard_normal((5, 3)) + rng.standard_normal((300, 3))
    rows = [([float(a) for a in v], *map(float, t)) for v, t in zip(x, y)]
    df = spark.createDataFrame(rows, "v array<double>, a double, b double, c double")
    one, two = ({(r["a"], r["b"]): r for r in shifts.angle_null(df.repartition(p), "v", ["a", "b", "c"], 60).collect()} for p in (2, 5))
    assert set(one) == {("a", "b"), ("a", "c"), ("b", "c")}
    for k in one:
        assert np.allclose(one[k][2:], two[k][2:]) and 1 / 61 <= one[k]["p"] <= 1 and one[k]["null_std"] > 0
        null = [r["null"] for r in shifts._null_excess(spark.createDataFrame([(0, 0.3, 0.5, 0.5)], "pair int, rho double, share_a double, share_b double"), np.ones(5) * 300, 300.0, 7, 0).collect()]
        assert len(set(null)) == 7


def test_ring_scan_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    th = rng.uniform(-np.pi, np.pi, 250)
    x = np.column_stack([3 * np.cos(2 * th), 2.5 * np.sin(2 * th), *rng.standard_normal((4, 250))]) + rng.normal(0, 0.3, (250, 6))
    df = spark.createDataFrame([([float(a) for a in v], float(t)) for v, t in zip(x, th)], "v array<double>, t double")
    got = {(r["pc_a"], r["pc_b"]): r for r in V.ring_scan(df, "v", "t", 2, 6).collect()}
    c = (x - x.mean(0)) @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2].T
    assert len(got) == 15
    for (i, j), r in got.items():
        a = np.column_stack([np.ones(250), c[:, i], c[:, j]])
        for name, y in (("r2_cos", np.cos(2 * th)), ("r2_sin", np.sin(2 * th))):
            e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
            assert np.isclose(r[name], 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean())))
        assert r["ring"] == min(r["r2_cos"], r["r2_sin"])
    assert max(got, key=lambda k: got[k]["ring"]) == (0, 1)


def test_random_pairs_come_from_the_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a) for a in rng.standard_normal(3)]) for i in range(41)]
    df = spark.createDataFrame(rows + [(90, None), (91, [float("nan"), 0.0, 0.0])], "id long, v array<double>").repartition(3)
    order = sorted(rows, key=lambda r: (int(hashlib.md5(f"0:{r[0]}".encode()).hexdigest()[:8], 16), r[0]))
    cos = [np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) for a, b in zip(order[::2], order[1::2])]
    got = L.random_pair_angles(df, "id", "v").first()
    assert got["dims"] == 3 and np.allclose([got["p5"], got["median"], got["p95"]], np.percentile(np.degrees(np.arccos(cos)), [5, 50, 95]))
    assert L.random_pair_angles(df.limit(0), "id", "v").count() == 0 or L.random_pair_angles(df.limit(0), "id", "v").first()["median"] is None
