"""Replicate matrices against copies of every row: same hashes, sums and percentiles, with nulls, ties, NaN and hot groups."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import hashing
from quillon.operators import inference, replicates

B = 12


def weight(seed, rep, key):
    u = int(hashlib.md5(f"{seed}:{rep}:{key}".encode()).hexdigest()[:8], 16) / 2**32
    return int(np.searchsorted(hashing.POISSON1_CDF, u, side="right"))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    out = [(i, ["hot", "hot", None, "cold"][i % 4], 7.0 if i % 5 == 0 else round(float(rng.normal()), 2), float(rng.normal())) for i in range(900)]
    out += [(1000 + i, "gap", None if i % 2 else 1.0 + i, None) for i in range(6)] + [(2000, "single", 3.0, 4.0), (2001, "none", None, 1.0)]
    return out + [(3000 + i, "wild", [float("inf"), 2.0, float("nan")][i % 3], 1.0) for i in range(40)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, x double, y double").repartition(5).cache()


def copies(rows):
    out = defaultdict(list)
    for i, g, x, y in rows:
        for rep in range(B):
            out[g, rep].append((weight(5, rep, i), x, y))
    return out


def test_weights_are_those_of_the_sql_expression(spark, table):
    u = hashing.hash32(5, F.lit(3), "id") / F.lit(hashing.SPAN)
    got = table.select("id", hashing.poisson1(u).alias("w")).collect()
    assert [r["w"] for r in got] == replicates.poisson(replicates.hashes(5, [3], [str(r["id"]) for r in got]))[:, 0].tolist()
    assert replicates.hashes("s", [0], [None])[0, 0] == spark.range(1).select(hashing.hash32("s", F.lit(0), F.lit(None).cast("string"))).first()[0]


@pytest.mark.parametrize("held", [1 << 21, 50])
def test_sums_match_copies(spark, table, rows, monkeypatch, held):
    monkeypatch.setattr(replicates, "HELD", held)
    monkeypatch.setattr(replicates, "BLOCK", 37)
    got = {(r["g"], r["rep"]): (r["m"], r["n"]) for r in inference.bootstrap(table, "id", {"m": lambda total: total(F.col("x") * F.col("y")) / total(), "n": lambda total: total()}, B, 5, ["g"]).collect()}
    want = {}
    for k, v in copies(rows).items():
        n = sum(w for w, _, _ in v)
        if n:
            parts = [w * x * y for w, x, y in v if w and x is not None and y is not None]
            want[k] = (sum(parts) / n if parts else None, n)
    assert got.keys() == want.keys()
    for k, (m, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None) == (m is None) and (m is None or np.isclose(got[k][0], m, equal_nan=True)), (k, got[k], m)


@pytest.mark.parametrize("sort, grid", [(20_000, 1000), (5, 8)])
@pytest.mark.parametrize("prob", [0.5, 0.03])
def test_quantiles_match_copies(spark, table, rows, monkeypatch, sort, grid, prob):
    monkeypatch.setattr(replicates, "SORTED", sort)
    monkeypatch.setattr(replicates, "GRID", grid)
    got = {(r["g"], r["rep"]): r["x"] for r in inference.bootstrap_quantile(table, "id", "x", prob, B, 5, ["g"]).collect()}
    want = {}
    for k, v in copies(rows).items():
        laid = sorted([x for w, x, _ in v if x is not None for _ in range(w)], key=lambda x: (x != x, x))
        if laid:
            pos = prob * (len(laid) - 1)
            lo, hi = laid[int(np.floor(pos))], laid[int(np.ceil(pos))]
            want[k] = lo + (hi - lo) * (pos - np.floor(pos))
    assert got.keys() == want.keys()
    assert all(np.isclose(got[k], want[k], equal_nan=True) for k in want)


def test_sign_flips_match_copies(spark, table, rows):
    got = {r["rep"]: r["median"] for r in inference.sign_flip_null(table.where("g = 'hot'"), "id", "x", B, 9).collect()}
    for rep in range(B):
        signs = [1 if int(hashlib.md5(f"9:{rep}:{i}".encode()).hexdigest()[:8], 16) % 2 == 0 else -1 for i, g, _, _ in rows if g == "hot"]
        assert np.isclose(got[rep], np.median([s * x for s, (_, g, x, _) in zip(signs, [r for r in rows if r[1] == "hot"])]))


def test_no_row_is_copied(spark, table):
    """No generator in any plan on the way, and an empty table gives no replicate."""
    made = [
        inference.intervals(inference.bootstrap(table, "id", {"m": lambda total: total(F.col("x")) / total()}, B, 5, ["g"]), ["m"], ["g"]),
        inference.bootstrap_quantile(table, "id", "x", 0.5, B, 5), inference.sign_flip_null(table, "id", "y", B, 5),
    ]
    assert not any("Generate" in m._jdf.queryExecution().toString() for m in made)
    none = table.limit(0)
    assert inference.bootstrap(none, "id", {"m": lambda total: total()}, B, 5).count() == 0 and inference.bootstrap_quantile(none, "id", "x", 0.5, B, 5, ["g"]).count() == 0
    assert inference.intervals(inference.bootstrap_quantile(none, "id", "x", 0.5, B, 5), ["x"]).count() == 0
