import numpy as np
from pyspark.sql import functions as F

from quillon.functions import angles, scalars
from quillon.operators import features, matching, sampling


def test_greedy_match_equals_the_sequential_pass(spark):
    rng = np.random.default_rng(0)
    s, p = rng.normal(0, 1, (40, 2)), rng.normal(0, 1, (60, 2))
    pri = rng.permutation(40).astype(float)
    src = spark.createDataFrame([(i, [float(a) for a in s[i]], float(pri[i])) for i in range(40)], "id long, f array<double>, pri double")
    pool = spark.createDataFrame([(1000 + j, [float(a) for a in p[j]]) for j in range(60)], "id long, f array<double>")
    taken, want = set(), {}
    for i in np.argsort(-pri):
        d = np.sqrt(((p - s[i]) ** 2).sum(1))
        for j in np.argsort(d, kind="stable"):
            if j not in taken:
                taken.add(j)
                want[int(i)] = 1000 + int(j)
                break
    for k in (3, 40):
        got = {r["src"]: r["dst"] for r in matching.greedy_match(src, pool, "id", "f", "pri", k=k).collect()}
        assert got == want


def test_pool_smaller_than_sources(spark):
    src = spark.createDataFrame([(i, [float(i)], float(i)) for i in range(5)], "id long, f array<double>, pri double")
    pool = spark.createDataFrame([(100, [0.0]), (101, [9.0])], "id long, f array<double>")
    got = {r["src"]: r["dst"] for r in matching.greedy_match(src, pool, "id", "f", "pri").collect()}
    assert got == {4: 100, 3: 101}


def test_quota_draw_is_exact_in_a_hot_bin(spark, split_plans):
    df = spark.range(3000).withColumn("b", F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(99))
    d = sampling.quota_draw(df, "id", "b", 25, 1)
    assert {r["b"]: r["count"] for r in d.groupBy("b").count().collect()} == {b: 25 for b in [*range(7), 99]}


def test_one_entry_rule_and_report(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 100).alias("chain"), F.floor(F.col("id") / 100).alias("bin"))
    d, rep = sampling.one_entry_draw(df, "id", "bin", "chain", {2: 60, 1: 30, 0: 50}, [2, 1, 0], 0)
    assert d.count() == d.select("chain").distinct().count() == 100
    assert {r["bin"]: r["n_drawn"] for r in rep.collect()} == {2: 60, 1: 30, 0: 10}


def test_importance_weights(spark):
    df = spark.range(1000).select(F.col("id"), F.col("id").alias("chain"), F.when(F.col("id") < 100, "far").otherwise("near").alias("shell"))
    d = sampling.importance_draw(df, "id", "shell", "chain", {"far": 10.0, "near": 1.0}, 300, ["far", "near"], 0)
    w = {r["shell"]: (r["n"], r["w"]) for r in d.groupBy("shell").agg(F.count("*").alias("n"), F.avg("weight").alias("w")).collect()}
    assert w["far"][0] == 100 and w["near"][0] == 200
    assert abs(d.agg(F.avg("weight")).first()[0] - 1) < 1e-9
    assert abs(w["far"][1] / w["near"][1] - 10.0 / (900 / w["near"][0])) < 1e-6


def test_mixture_index_and_controls(spark):
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(0, 1, (150, 2)), np.column_stack([np.full(150, 2.0), rng.normal(0, 1, 150)])])
    df = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "cluster int, id long, x double, y double")
    m = features.mixture_index(df, n_phi=16, n_offsets=21, refine=(8, 21)).first()["mixture"]
    assert 0.5 <= m <= 0.6
    mom = spark.createDataFrame([(i, 1.0, float(10 ** (i % 10))) for i in range(100)], "feature int, std double, energy double")
    chosen = spark.createDataFrame([(i,) for i in range(10)], "feature int")
    c = features.matched_controls(mom, chosen, 3).join(mom, "feature").groupBy("control").agg(F.count("*").alias("n"), F.sum("energy").alias("e")).collect()
    assert all(r["n"] == 10 and r["e"] == 1111111111.0 for r in c)


def test_mixture_cut_between_means(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 1500), rng.normal(6, 1, 1500)])
    c = features.two_component_cut(spark.createDataFrame([(float(a),) for a in x], "x double"), "x")
    assert abs(c["low"]) < 0.2 and abs(c["high"] - 6) < 0.2 and abs(c["cut"] - 3) < 0.3


def test_mixture_is_the_most_likely_one(spark):
    """Overlapping components, where steps get small long before the fit is there; other values than numbers are left out."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 2000), rng.normal(2.5, 1.5, 1000)])
    m, v, w = np.array([0.0, 2.5]), np.array([1.0, 2.25]), np.array([2 / 3, 1 / 3])
    for _ in range(20_000):
        d = w / np.sqrt(2 * np.pi * v) * np.exp(-((x[:, None] - m) ** 2) / (2 * v))
        r = d / d.sum(1, keepdims=True)
        w = r.mean(0)
        m = (r * x[:, None]).sum(0) / r.sum(0)
        v = (r * (x[:, None] - m) ** 2).sum(0) / r.sum(0)
    df = spark.createDataFrame([(float(a),) for a in x] + [(None,), (float("nan"),), (float("-inf"),)], "x double")
    c = features.two_component_cut(df, "x")
    assert np.allclose([c["low"], c["high"], c["var_low"], c["var_high"], c["share_low"]], [*m, *v, w[0]], rtol=1e-5)


def test_missing_value_rules(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (-99.0,), (None,)], "x double")
    assert [r[0] for r in df.select(scalars.clean("x", floor=-98)).collect()] == [1.0, None, None, None, None]
    assert [r[0] for r in df.select(scalars.flag(scalars.finite("x") > 0.8)).collect()] == [True, False, False, False, False]


def test_axial_wrap_and_seam(spark):
    df = spark.createDataFrame([(90.0, 179.0, 1.0)], "a double, p double, q double")
    r = df.select(angles.axial_wrap("a"), angles.circular_error(2 * F.radians("p"), 2 * F.radians("q"), 2)).first()
    assert r[0] == -90.0 and abs(r[1] - 2.0) < 1e-9


def test_shape_identities(spark):
    rows = [(a / 10, b / 10) for a in range(-5, 6) for b in range(-5, 6)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "a double, b double")
    for r in df.select("a", "b", scalars.ellipticity("a", "b").alias("e"), scalars.axis_ratio("a", "b").alias("q"), scalars.position_angle("a", "b").alias("pa")).collect():
        e = np.hypot(r["a"], r["b"])
        assert abs(r["e"] - e) < 1e-9 and abs(r["q"] - (1 - e) / (1 + e)) < 1e-9
        assert abs(r["pa"] - np.degrees(np.arctan2(r["b"], r["a"]) / 2) % 180) < 1e-9 or abs(abs(r["pa"] - np.degrees(np.arctan2(r["b"], r["a"]) / 2) % 180) - 180) < 1e-9


def test_level_cap_fills_the_total_as_far_as_it_goes():
    for counts, total in (([5, 100, 100], 105), ([1, 2, 3], 100), ([10, 10, 10], 29), ([7], 3), ([], 5), ([0, 4, 9, 30], 20), ([3, 3], 1)):
        cap = sampling.level_cap(counts, total)
        filled = [sum(min(c, k) for c in counts) for k in (cap, cap + 1)]
        assert filled[0] <= total and (filled[1] > total or cap == max(counts, default=0))


def test_greedy_match_searches_again_among_rows_still_to_be_had(spark, monkeypatch):
    """Sources and pool in one place each: lists run out, and a search that asked for the whole pool would hold all pairs."""
    rng = np.random.default_rng(4)
    src = rng.standard_normal((45, 2)) * 0.1
    pool = np.r_[rng.standard_normal((25, 2)) * 0.1, rng.standard_normal((10, 2)) + 4.0]
    pri = rng.permutation(45) * 1.0
    a = spark.createDataFrame([(i, [float(z) for z in r], float(p)) for i, (r, p) in enumerate(zip(src, pri))] + [(900, None, 7.0)], "id long, v array<double>, p double")
    b = spark.createDataFrame([(1000 + i, [float(z) for z in r], 0.0) for i, r in enumerate(pool)] + [(9000, None, 0.0)], "id long, v array<double>, p double")
    free, want = set(range(35)), {}
    for i in np.argsort(-pri):
        if free:
            want[int(i)] = min(free, key=lambda j: (np.linalg.norm(pool[j] - src[i]), j))
            free.remove(want[int(i)])
    asked, search = [], matching.knn.knn_join
    monkeypatch.setattr(matching.knn, "knn_join", lambda q, b, k, *x, **kw: asked.append((q.count(), min(k, b.count()))) or search(q, b, k, *x, **kw))
    monkeypatch.setattr(matching, "WIDER_ROWS", 100)
    got = {r["src"]: r["dst"] - 1000 for r in matching.greedy_match(a, b, "id", "v", "p", k=5).collect()}
    assert got == want
    assert all(n * k <= max(5 * n, 100) for n, k in asked)
