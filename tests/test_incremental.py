"""Incremental work: compound marks lose no tie, finished keys are kept in state, replays replace themselves."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.streaming import incremental


def test_equal_marks_all_come(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") < 990, 1).otherwise(F.col("id")).cast("long").alias("mark")).repartition(7).cache()
    out, seen, target = str(tmp_path / "o"), [], 10
    while len(seen) < 1000 and target <= 4000:
        before = len(seen)
        got = incremental.run_marked(df, out, "mark", "id", target, lambda d: d)
        seen = [r["id"] for r in got.collect()]
        assert len(seen) == min(target, 1000) and len(set(seen)) == len(seen) and len(seen) > before
        target += 10 if target < 30 else 330
    assert sorted(seen) == list(range(1000))
    assert incremental.run_marked(df, out, "mark", "id", 5000, lambda d: d).count() == 1000


def test_a_run_reads_no_earlier_output_and_replaces_itself(spark, tmp_path):
    df = spark.range(50).select("id", F.lit("same").alias("mark"))
    out = str(tmp_path / "o")
    incremental.run_marked(df, out, "mark", "id", 20, lambda d: d)

    def breaks(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        incremental.run_marked(df, out, "mark", "id", 30, breaks)
    spark.range(100, 103).select("id", F.lit("junk").alias("mark")).write.parquet(f"{out}/run=2")  # written, but the mark did not move on
    got = incremental.run_marked(df, out, "mark", "id", 30, lambda d: d).collect()
    assert sorted(r["id"] for r in got) == list(range(30))
    assert incremental.run_marked(df.limit(0), str(tmp_path / "none"), "mark", "id", 5, lambda d: d).count() == 0


def test_continue_from_takes_the_rest_of_a_mark(spark):
    rows = [(1, k) for k in range(5)] + [(2, 9), (None, 3), (2, None)]
    df = spark.createDataFrame(rows, "mark long, id long")
    done = df.limit(0)
    for target in (2, 4, 6, 8):
        done = spark.createDataFrame([tuple(r) for r in done.union(incremental.continue_from(df, done, "mark", target, "id")).collect()], df.schema)
    assert sorted(map(tuple, done.collect())) == [*[(1, k) for k in range(5)], (2, 9)]


@pytest.mark.parametrize("expiry", [None, "1 hour"])
def test_finished_keys_are_skipped_without_reading_the_output(spark, tmp_path, monkeypatch, expiry):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.LongType())])
    src, out, cp = (str(tmp_path / n) for n in ("s", "o", "c"))
    part = lambda low, high, n: spark.range(low, high).select("id", F.lit(n).cast("long").alias("v")).coalesce(1).write.parquet(f"{src}/part={n}")
    reads = []
    read = incremental._read_or_empty
    monkeypatch.setattr(incremental, "_read_or_empty", lambda *a: reads.append(a[1]) or read(*a))
    part(0, 10, 0)
    run = lambda: incremental.run_incremental(spark, f"{src}/part=*", schema, out, cp, "id", lambda d: d, schema, expiry=expiry)
    assert run().count() == 10
    part(5, 20, 1)
    spark.createDataFrame([(None, 7), (None, 8), (25, 7), (25, 8)], schema).coalesce(1).write.parquet(f"{src}/part=2")
    got = [(r["id"], r["v"]) for r in run().collect()]
    assert sorted(i for i, _ in got if i is not None) == [*range(20), 25] and sum(i is None for i, _ in got) == 1
    assert all(v == 0 for i, v in got if i is not None and i < 10)
    assert len(reads) == 2  # once at the end of each run, for the caller
    assert spark.conf.get(incremental.PROVIDER) == incremental.MEMORY


def test_an_expired_key_is_taken_again(spark, tmp_path):
    import time

    schema = T.StructType([T.StructField("id", T.LongType())])
    src, out, cp = (str(tmp_path / n) for n in ("s", "o", "c"))
    run = lambda: incremental.run_incremental(spark, f"{src}/part=*", schema, out, cp, "id", lambda d: d, schema, expiry="1 second")
    for n in range(3):
        spark.range(1).write.parquet(f"{src}/part={n}")
        got = run().count()
        time.sleep(2)
    assert got == 2  # the second batch still knows the key, the third no longer
