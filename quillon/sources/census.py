"""What is in a set of tables: census, schema differences and order-free fingerprints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.scalars import finite
from quillon.operators import ranking


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# Labels for a column by where its median lies: (label, least median, past the largest). Callers may pass their own.
SCALES = [("negative", float("-inf"), 0.0), ("small", 0.0, 10.0), ("large", 10.0, float("inf"))]


def label_by_range(median: Column, scales=SCALES) -> Column:
    """The label of the first range [low, high) that holds the median; NULL without one."""
    return F.coalesce(*[F.when((median >= low) & (median < high), F.lit(name)) for name, low, high in scales])


def census(tables: Mapping[str, DataFrame], probe: Mapping[str, str], scales=SCALES) -> DataFrame:
    """One row per table: columns, rows, the exact median of the probed column over all rows, the label of the
    range that the median lies in, and the other tables with the same row count.

    ``probe`` names the numeric column per table.
    """
    rows = []
    for name, df in tables.items():
        base = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("product", F.lit(name))
        base = base.withColumn("n_columns", F.lit(len(df.columns)))
        base = base.withColumn("types", F.lit(",".join(sorted({f.dataType.simpleString() for f in df.schema.fields}))))
        if name in probe:
            middle = ranking.quantiles(df.select(finite(probe[name]).alias("v")), "v", [0.5], names=["sample_median"])
            base = base.crossJoin(F.broadcast(middle.agg(F.max("sample_median").alias("sample_median"))))  # one row, also without values
        else:
            base = base.withColumn("sample_median", F.lit(None).cast("double"))
        rows.append(base)
    out = _union(rows).withColumn("convention", label_by_range(F.col("sample_median"), scales))
    same = out.groupBy("n_rows").agg(F.sort_array(F.collect_list("product")).alias("_peers"))
    return out.join(same, "n_rows").select(
        "product", "n_rows", "n_columns", "types", "sample_median", "convention",
        F.concat_ws(",", F.array_remove("_peers", F.col("product"))).alias("same_rows"),
    )


def schema_table(df: DataFrame, name: str) -> DataFrame:
    """(column, type, rows) of a table."""
    fields = [(f.name.lower(), f.dataType.simpleString()) for f in df.schema.fields]
    meta = df.sparkSession.createDataFrame(fields, "column string, type string")
    return meta.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("rows")))).withColumn("product", F.lit(name))


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Column by column: only in one table, or the same, or different in type or row count."""
    a = schema_table(left, "l").select("column", F.col("type").alias("left_type"), F.col("rows").alias("left_rows"))
    b = schema_table(right, "r").select("column", F.col("type").alias("right_type"), F.col("rows").alias("right_rows"))
    verdict = (
        F.when(F.col("right_type").isNull(), "only_left")
        .when(F.col("left_type").isNull(), "only_right")
        .when(F.col("left_type") != F.col("right_type"), "type_differs")
        .when(F.col("left_rows") != F.col("right_rows"), "rows_differ")
        .otherwise("same")
    )
    return a.join(b, "column", "full").select("column", "left_type", "right_type", "left_rows", "right_rows", verdict.alias("verdict"))


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Row count, schema and an order-free sum of row hashes (decimal, so it cannot overflow)."""
    cols = [
        F.to_json(F.struct(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias("hash_sum"),
    ).select(F.lit(name).alias("product"), "n_rows", "hash_sum", F.lit(df.schema.simpleString()).alias("schema"))


def fingerprints(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union([fingerprint(df, name) for name, df in tables.items()])


def verify_fingerprints(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Compare against stored fingerprints: ok, changed, missing now, or not in the manifest."""
    c, m = current.alias("c"), manifest.alias("m")
    same = (F.col("c.n_rows") == F.col("m.n_rows")) & (F.col("c.hash_sum") == F.col("m.hash_sum")) & (F.col("c.schema") == F.col("m.schema"))
    status = (
        F.when(F.col("c.product").isNull(), "missing").when(F.col("m.product").isNull(), "new")
        .when(same, "ok").otherwise("changed")
    )
    return c.join(m, F.col("c.product") == F.col("m.product"), "full").select(
        F.coalesce("c.product", "m.product").alias("product"), status.alias("status")
    )


def column_profile(df: DataFrame, columns: Mapping[str, float | None]) -> DataFrame:
    """Coverage per column: finite, valid above the declared floor, sentinel and exact-zero counts, in one pass."""
    aggs = []
    for c, floor in columns.items():
        x = finite(c)
        ok = x.isNotNull() if floor is None else (x > F.lit(floor))
        ok = F.coalesce(ok, F.lit(False))
        aggs += [
            F.count_if(x.isNotNull()).alias(f"{c}__fin"),
            F.count_if(ok).alias(f"{c}__ok"),
            F.count_if(x == 0).alias(f"{c}__zero"),
        ]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"{c}__fin").alias("n_finite"), F.col(f"{c}__ok").alias("n_valid"),
            (F.col(f"{c}__fin") - F.col(f"{c}__ok")).alias("n_sentinel"), F.col(f"{c}__zero").alias("n_zero"),
            (F.col(f"{c}__ok") / F.col("_n")).alias("coverage"),
        )
        for c in columns
    ]
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def describe(df: DataFrame, columns, percentiles=(1, 50, 99)) -> DataFrame:
    """Finite count, percentiles, minimum and maximum per column."""
    clean = df.select(*[finite(c).alias(c) for c in columns])
    names = [f"p{p}" for p in percentiles]
    q = ranking.quantiles_of(clean, columns, [p / 100.0 for p in percentiles], names)
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns]
    basic = (
        clean.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.metric")
        .agg(F.count("p.value").alias("n_finite"), F.min("p.value").alias("min"), F.max("p.value").alias("max"))
    )
    return basic.join(q, "metric")
