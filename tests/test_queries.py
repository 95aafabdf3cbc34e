import os
import time

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.sources import census, readers
from quillon.streaming import incremental

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# One query per module; tools/check.py runs all of them.
PICK = ["shard_gather", "quantile_profile", "sky_crossmatch", "knn_topk", "forman", "spearman_by_group", "bh_qvalues", "feature_label_spearman", "hist_match_draw", "incremental_match"]


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")
@pytest.mark.parametrize("name", PICK)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert cols == sorted(rel.columns)
    pos = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in pos) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert len(got) == len(want) and got == want


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_shard_bounds(spark):
    for n, t in ((10, 3), (7, 7), (100, 6)):
        got = [r[0] for r in spark.range(n).select(readers.shard_of("id", n, t)).collect()]
        want = [next(s for s in range(t) if s * n // t <= i < (s + 1) * n // t) for i in range(n)]
        assert got == want


def test_fingerprint_ignores_order_and_sees_a_change(spark):
    df = spark.range(100).selectExpr("id", "id * 2 as x")
    a = census.fingerprint(df, "t").first()
    assert a == census.fingerprint(df.orderBy("id", ascending=False), "t").first()
    assert a != census.fingerprint(df.selectExpr("id", "if(id = 5, 0, x) as x"), "t").first()


def test_chunks_are_not_redone(spark, tmp_path):
    path = str(tmp_path / "chunks")
    df = spark.range(20).selectExpr("id", "id % 4 as c")
    incremental.run_chunks(df.where("c < 2"), "c", lambda d: d, path, ["id"])
    first = {f: os.path.getmtime(f) for f in _files(path)}
    time.sleep(0.05)
    out = incremental.run_chunks(df, "c", lambda d: d, path, ["id"])
    assert [r["id"] for r in out.select("id").collect()] == list(range(20))
    assert all(os.path.getmtime(f) == t for f, t in first.items())


def _files(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
