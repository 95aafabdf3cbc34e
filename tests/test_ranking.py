import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import inference, ranking


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i % 3 else "cold", 7.0 if i % 3 == 1 else float(rng.normal())) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g string, x double").cache(), rows


@pytest.mark.parametrize("split", [False, True])
def test_ranks_and_quantiles_match_numpy(spark, skewed, split):
    df, rows = skewed
    spark.conf.set("spark.quillon.rangeRows", "37" if split else "100000")
    for g in ("hot", "cold"):
        v = np.array([r[2] for r in rows if r[1] == g])
        got = {r["x"]: r["avg_rank"] for r in ranking.average_ranks(df, "x", ["g"]).where(F.col("g") == g).collect()}
        order = np.sort(v)
        for x in (v.min(), 7.0, np.median(order)):
            if x in got:
                lo, hi = np.searchsorted(order, x, "left"), np.searchsorted(order, x, "right")
                assert got[x] == (lo + 1 + hi) / 2
        assert len(got) == len(set(v))
        q = ranking.quantiles(df, "x", [0, 0.05, 0.5, 0.95, 1], ["g"]).where(F.col("g") == g).first()
        assert np.allclose(q[1:], np.quantile(v, [0, 0.05, 0.5, 0.95, 1]))
    c = ranking.ecdf(df, "x", ["g"]).where(F.col("g") == "hot").orderBy("i").collect()
    assert [r["i"] for r in c] == list(range(1, len(c) + 1))
    spark.conf.unset("spark.quillon.rangeRows")


def test_weighted_quantile_both_plans(spark, skewed):
    df, _ = skewed
    w = F.col("id") % 4
    a = ranking.quantiles(df, "x", [0.5], ["g"], weight=w).orderBy("g").collect()
    spark.conf.set("spark.quillon.rangeRows", "37")
    b = ranking.quantiles(df, "x", [0.5], ["g"], weight=w).orderBy("g").collect()
    spark.conf.unset("spark.quillon.rangeRows")
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_hash_order_is_the_same_in_both_plans(spark, skewed):
    df, rows = skewed
    a = {r["id"]: r["rn"] for r in ranking.hash_order(df, "id", 5, ["g"]).collect()}
    spark.conf.set("spark.quillon.rangeRows", "37")
    b = {r["id"]: r["rn"] for r in ranking.hash_order(df, "id", 5, ["g"]).collect()}
    spark.conf.unset("spark.quillon.rangeRows")
    assert a == b and len(a) == len(rows)


def test_row_rank_and_null(spark, split_plans):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None), (4, 1.0)], "id long, x double")
    got = {r["id"]: r["r"] for r in ranking.with_average_rank(df, "x", "r").collect()}
    assert got == {1: 2.5, 2: 2.5, 3: None, 4: 1.0}


def test_bh_matches_definition(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(400) ** 2, 3)
    df = spark.createDataFrame([(float(x),) for x in p], "p double")
    o = np.argsort(p, kind="stable")
    ranked = p[o] * len(p) / np.arange(1, len(p) + 1)
    q = np.minimum.accumulate(ranked[::-1])[::-1].clip(0, 1)
    want = {}
    for x, y in zip(p[o], q):
        want[x] = min(y, want.get(x, 2))
    for chunk in (100_000, 7):
        got = {r["p"]: r["q"] for r in inference.bh_qvalues(df, "p", chunk=chunk).collect()}
        assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_poisson_weights_have_unit_mean(spark):
    df = spark.range(2000)
    w = inference.bootstrap(df, "id", {"s": lambda total: total()}, 20, 3).collect()
    means = [r["s"] / 2000 for r in w]
    assert len(means) == 20 and abs(np.mean(means) - 1) < 0.02


def test_shuffle_is_a_permutation(spark, split_plans):
    df = spark.range(500).withColumn("x", F.when(F.col("id") % 5 != 0, F.col("id") * 1.0))
    r = inference.shuffle_within(df, "id", "x", 1, "y").collect()
    assert sorted(x["y"] for x in r if x["x"] is not None) == sorted(x["x"] for x in r if x["x"] is not None)
    assert all(x["y"] is None for x in r if x["x"] is None) and any(x["x"] != x["y"] for x in r)


def test_large_sample_equals_the_full_sort(spark):
    df = spark.range(20000)
    want = [r["id"] for r in df.withColumn("h", ranking.hashing.hash32(3, "id")).orderBy("h", "id").limit(1500).collect()]
    got = [r["id"] for r in ranking.sample_n(df, "id", 1500, 3).collect()]
    assert sorted(got) == sorted(want)


def test_copies_are_laid_out_in_slices(spark, split_plans, monkeypatch):
    monkeypatch.setattr(ranking, "COPIES", 7)
    df = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 3, "x double")
    got = ranking.ecdf(df, "x").orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(1, 54)) and [r["x"] for r in got] == [1.0] * 50 + [2.0] * 3


@pytest.fixture(scope="module")
def awkward(spark):
    rng = np.random.default_rng(4)
    rows = [(i, ["hot", "hot", None, "cold", "hot"][i % 5], float(rng.normal()) if i % 3 else 0.25) for i in range(6000)]
    rows += [(i, "nan", [float("nan"), 1.0, 2.0, float("inf")][i % 4]) for i in range(400)] + [(i, "inf", [float("-inf"), 3.0, float("inf")][i % 3]) for i in range(300)]
    rows += [(i, "none", None) for i in range(5)] + [(i, "one", 5.0) for i in range(1)] + [(i, "same", 7.0) for i in range(700)]
    return spark.createDataFrame(rows, "id long, g string, x double").repartition(5), rows


def same(got, want):
    return sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("few, sketch, slack", [(4096, 10_000, 4), (50, 400, 4), (50, 200, 4), (0, 20, -0.5)])
def test_bracketed_quantiles_are_exact(spark, awkward, monkeypatch, split_plans, few, sketch, slack):
    """Also where brackets are so narrow that they miss and groups are ranked in full."""
    for name, v in (("FEW", few), ("SKETCH", sketch), ("SLACK", slack)):
        monkeypatch.setattr(ranking, name, v)
    df, _ = awkward
    probs = [0.0, 0.05, 0.5, 0.51, 1.0]
    want = ranking.ranked_quantiles(df, "x", probs, ["g"]).collect()
    assert len(want) == 7  # a group without values has no row
    assert same(map(tuple, ranking.quantiles(df, "x", probs, ["g"]).collect()), map(tuple, want))
    some = df.where("g = 'hot'")
    assert same(map(tuple, ranking.quantiles(some, "x", [0.25]).collect()), map(tuple, ranking.ranked_quantiles(some, "x", [0.25]).collect()))
    assert ranking.quantiles(df.where("g = 'none'"), "x", [0.5], ["g"]).count() == 0


def test_bracketed_quantiles_keep_few_rows(spark, monkeypatch):
    df = spark.range(200_000).select(F.xxhash64("id").cast("double").alias("x"))
    bounds = ranking.brackets(df, "x", [0.5, 0.9])
    kept = ranking.reduced_counts(df, "x", bounds, [("_lo0", "_hi0"), ("_lo1", "_hi1")], []).where("_sure").count()
    assert 0 < kept < 200_000 * 2 * 2 * (ranking.SLACK + 2) / ranking.SKETCH


@pytest.mark.parametrize("few", [4096, 50])
def test_robust_scatter_matches_numpy(spark, monkeypatch, few):
    from quillon.operators import profiles

    monkeypatch.setattr(ranking, "FEW", few)
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(2, 3, 3001), "b": np.round(rng.normal(0, 2, 900)), None: rng.exponential(1, 500), "few": np.array([1.0, 5.0]), "tie": np.r_[np.zeros(400), rng.normal(size=100)]}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, r double").repartition(4)
    got = {r["g"]: r for r in profiles.robust_scatter(df, "r", ["g"]).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        m = np.median(v)
        assert np.allclose([got[g]["n"], got[g]["bias"], got[g]["sigma_mad"], got[g]["outlier_share"], got[g]["rms"]], [len(v), m, 1.4826 * np.median(np.abs(v - m)), np.mean(np.abs(v) > 0.15), np.sqrt(np.mean(v * v))])
    v = groups["a"]
    one = profiles.robust_scatter(df.where("g = 'a'"), "r").first()
    assert np.allclose([one["bias"], one["sigma_mad"]], [np.median(v), 1.4826 * np.median(np.abs(v - np.median(v)))])
    wild = spark.createDataFrame([(float(x),) for x in [np.inf, -np.inf, 1, 2, 3] * 30 + [np.nan] * 3], "r double")
    assert profiles.robust_scatter(wild, "r").first()["bias"] == 2.0


def test_robust_scatter_ranks_groups_whose_brackets_miss(spark, monkeypatch):
    from quillon.operators import profiles

    monkeypatch.setattr(ranking, "FEW", 10)
    narrow = profiles._scatter_brackets
    monkeypatch.setattr(profiles, "_scatter_brackets", lambda *a: narrow(*a).withColumn("_d2", F.when(F.col("g") == "a", F.col("_d1")).otherwise(F.col("_d2"))).withColumn("_m1", F.when(F.col("g") == "b", F.col("_m2") + 9).otherwise(F.col("_m1"))))
    rng = np.random.default_rng(9)
    groups = {g: rng.normal(1, 2, 801) for g in "abc"}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, r double")
    for r in profiles.robust_scatter(df, "r", ["g"]).collect():
        v = groups[r["g"]]
        assert np.allclose([r["bias"], r["sigma_mad"]], [np.median(v), 1.4826 * np.median(np.abs(v - np.median(v)))])
