import math

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import intervals, joins, spatial


def _sep(a, b):
    u = lambda p: np.array([math.cos(p[1]) * math.cos(p[0]), math.cos(p[1]) * math.sin(p[0]), math.sin(p[1])])
    c = np.linalg.norm(u(np.radians(a)) - u(np.radians(b)))
    return math.degrees(2 * math.asin(min(c / 2, 1))) * 3600


def test_sky_match_wraps_and_reaches_the_poles(spark):
    rng = np.random.default_rng(0)
    t = [(i, float(rng.uniform(0, 360)), float(rng.choice([-1, 1]) * rng.uniform(88.5, 90))) for i in range(60)]
    t += [(100 + i, float(rng.choice([0.01, 359.99]) + 0 * i) % 360, float(rng.uniform(-5, 5))) for i in range(60)]
    r = [(i, float(rng.uniform(0, 360)), float(rng.choice([-1, 1]) * rng.uniform(88.5, 90))) for i in range(300)]
    r += [(1000 + i, float(rng.uniform(-0.5, 0.5)) % 360, float(rng.uniform(-5, 5))) for i in range(300)]
    r += [(5000 + i, t[0][1], t[0][2]) for i in range(50)]  # copies at one place
    rad = 1500.0
    td, rd = spark.createDataFrame(t, "tid long, ra double, dec double"), spark.createDataFrame(r, "rid long, ra double, dec double")
    want = {}
    allp = set()
    for a in t:
        s = [(_sep(a[1:], b[1:]), b[0]) for b in r]
        allp |= {(a[0], j) for d, j in s if d <= rad}
        best = min(s)
        if best[0] <= rad:
            want[a[0]] = best
    got = {x["tid"]: (x["sep"], x["rid"]) for x in spatial.sky_nearest(td, rd, "tid", "rid", rad).collect()}
    assert set(got) == set(want)
    assert all(got[k][1] == want[k][1] or abs(got[k][0] - want[k][0]) < 1e-6 for k in want)
    hits = spatial.sky_all(td, rd, "tid", "rid", rad, metric="sphere").collect()
    assert {(x["tid"], x["rid"]) for x in hits if x["rid"] is not None} == allp
    assert {x["tid"] for x in hits} == {a[0] for a in t}


def test_salting_keeps_every_pair(spark):
    l = spark.range(20).select(F.col("id").alias("a"), F.lit(1).alias("k"))
    r = spark.range(100).select(F.col("id").alias("b"), F.lit(1).alias("k"))
    x, y, keys = joins.salt_hot_keys(l, r, ["k"], "b", limit=10)
    assert len(keys) == 2 and x.join(y, keys).select("a", "b").distinct().count() == 2000 == x.join(y, keys).count()


def test_periodic_mutual_nearest(spark):
    rng = np.random.default_rng(3)
    box, tol = 100.0, 9.0
    a, b = rng.uniform(0, box, (150, 3)), rng.uniform(0, box, (170, 3))
    d = a[:, None] - b[None]
    d = np.sqrt(((d - box * np.rint(d / box)) ** 2).sum(-1))
    ab, ba = d.argmin(1), d.argmin(0)
    want = {(i, int(ab[i])) for i in range(150) if ba[ab[i]] == i and d[i, ab[i]] < tol}
    df = lambda m, n: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(m)], f"{n} long, x double, y double, z double")
    got = spatial.mutual_nearest_periodic(df(a, "a"), df(b, "b"), "a", "b", box, tol).collect()
    assert {(r["a"], r["b"]) for r in got} == want


def test_periodic_matching_never_broadcasts_repeated_positions(spark):
    df = lambda n, seed: spark.range(500).select(F.col("id").alias(n), *[(F.rand(seed + i) * 100).alias(c) for i, c in enumerate("xyz")])
    best = spatial._nearest_periodic(df("a", 1), df("b", 5), "b", 100.0, 9.0)
    assert best.count()
    plan = best._jdf.queryExecution().executedPlan().toString()
    best.collect()
    plan += best._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_periodic_rounds_settle_a_dense_box(spark, monkeypatch):
    rng = np.random.default_rng(4)
    box, tol = 100.0, 60.0
    monkeypatch.setattr(spatial, "CELL_ROWS", 4.0)
    a, b = rng.uniform(0, box, (300, 3)), np.vstack([rng.uniform(0, 30, (200, 3)), rng.uniform(0, box, (5, 3))])  # one corner full, the rest empty
    d = a[:, None] - b[None]
    d = np.sqrt(((d - box * np.rint(d / box)) ** 2).sum(-1))
    want = {tuple(a[i]): int(j) for i, j in enumerate(d.argmin(1)) if d[i, j] < tol}
    df = lambda m, n: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(m)], f"{n} long, x double, y double, z double")
    asked, within = [], spatial._nearest_within
    monkeypatch.setattr(spatial, "_nearest_within", lambda s, *r: asked.append((s.count(), r[-1])) or within(s, *r))
    got = spatial._nearest_periodic(df(a, "a"), df(b, "b"), "b", box, tol).collect()
    assert {(r["x"], r["y"], r["z"]): r["b"] for r in got} == want and len(got) == len(want)
    assert [r for _, r in asked][-1] == tol and len(asked) > 1 and asked[-1][0] < asked[0][0]


def test_intervals_drop_gaps_and_flag_zero_radius(spark):
    owners = spark.createDataFrame([(0, 0, 5, 1.0), (1, 7, 40, 0.0), (2, 60, 0, 1.0)], "o long, offset long, n long, radius double").withColumns({c: F.lit(0.5) for c in ("x", "y", "z")})
    rows = spark.range(100).select(F.col("id").alias("i"), F.lit(1.0).alias("m"), F.lit(0.05).alias("age"), F.lit(0.1).alias("met"), *[F.lit(99.9).alias(c) for c in ("px", "py", "pz")])
    for block in (1, 3, 64):
        j = intervals.interval_join(rows, owners, "i", "offset", "n", block=block)
        assert {(r["o"], r["i"]) for r in j.collect()} == {(0, i) for i in range(5)} | {(1, i) for i in range(7, 47)}
    agg = {r["o"]: r for r in intervals.member_aggregates(j, owners, "o", "m", "age", "met", "radius", 100.0).collect()}
    assert agg[0]["mass_in2"] == 5.0 and agg[0]["mass_in1"] == 0.0 and agg[0]["flag"] == ""
    assert agg[1]["mass_in2"] is None and agg[1]["flag"] == "radius<=0" and agg[1]["mass_total"] == 40.0
    assert agg[2]["flag"] == "empty"
    n = {r["o"]: r for r in intervals.naive_versus_wrapped(j.where("o = 0"), "o", "m", "radius", 100.0).collect()}
    assert n[0]["wrapped_mass"] > n[0]["naive_mass"] and n[0]["n_wrapped"] == 5


def test_asof_join_both_plans(spark):
    rng = np.random.default_rng(5)
    right = sorted({(int(rng.integers(3)), float(rng.integers(1000))) for _ in range(300)})
    left = [(i, int(rng.integers(3)), float(rng.integers(1000))) for i in range(400)]
    want = {}
    for i, g, t in left:
        c = [x for h, x in right if h == g and x <= t]
        want[i] = max(c) * 2 if c else None
    l = spark.createDataFrame(left, "id long, g int, t double")
    r = spark.createDataFrame([(g, x, x * 2) for g, x in right], "g int, t double, v double")
    for small in ("1000000", "20"):
        spark.conf.set("spark.quillon.rangeRows", small)
        got = {x["id"]: x["v"] for x in joins.asof_join(l, r, "t", ["v"], ["g"]).collect()}
        assert got == want
    spark.conf.unset("spark.quillon.rangeRows")
