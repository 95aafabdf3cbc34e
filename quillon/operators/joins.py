"""Key joins, alignment checks, step lookups and grid interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import runtime
from quillon.functions.scalars import col


def grid_interpolate(
    df: DataFrame, x: str, grid: DataFrame, node: str, y: str, lo: float, step: float, out: str
) -> DataFrame:
    """Linear interpolation on a uniform grid: the index is arithmetic, so this is one equi-join on the node.

    The grid carries each node's value and its right neighbour; values outside the grid are clamped to its ends.
    """
    from pyspark.sql import Window

    w = Window.orderBy(node)  # grid rows only
    g = grid.select(F.col(node).alias("_node"), F.col(y).alias("_y0"), F.coalesce(F.lead(y).over(w), F.col(y)).alias("_y1"))
    last = grid.agg(F.max(node)).first()[0]
    pos = F.least(F.greatest((col(x) - F.lit(lo)) / F.lit(step), F.lit(0.0)), F.lit(float(last)))
    keyed = df.withColumn("_pos", pos).withColumn("_node", F.floor("_pos"))
    joined = keyed.join(runtime.broadcast_checked(g, last + 1), "_node", "left")
    return joined.withColumn(out, F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (F.col("_pos") - F.col("_node"))).drop("_node", "_pos", "_y0", "_y1")


def salt_hot_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], row_key: str, limit: int = 20_000):
    """Split the rows of over-full keys on the right into salts and repeat the left rows for each salt.

    Returns (left, right, join keys). Keys under ``limit`` rows are untouched, and when no key is over-full both
    sides come back as they were. No row is dropped: each left row still meets every right row of its key.
    """
    keys = list(keys)
    hot = (
        right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_salts"))
    )
    n_hot = hot.count()
    if n_hot == 0:
        return left, right, keys
    hot = runtime.broadcast_checked(hot, n_hot)
    salts = F.coalesce("_salts", F.lit(1))
    split = right.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(row_key), salts).cast("int")).drop("_salts")
    repeated = (
        left.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    )
    return repeated, split, [*keys, "_salt"]


def asof_join(
    left: DataFrame, right: DataFrame, on: str, values: Sequence[str], by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Attach to each left row the values of the last right row with the same ``by`` and ``on`` not above its own.

    Both sides are cut into ranges of ``on``; each range is scanned on its own, and the last right row of all
    earlier ranges is carried in from a small per-range table, so a hot key is spread over its ranges.
    """
    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import Window

    by, values = list(by), list(values)
    buckets = buckets or runtime.bucket_count(left.count() + right.count(), left.sparkSession)
    edges = None
    if buckets > 1:
        fine = right.where(~F.isnan(F.col(on).cast("double")))
        edges = fine.agg(F.percentile_approx(F.col(on).cast("double"), [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0]
    splits = [float("-inf"), *sorted(set(edges or [])), float("inf")]
    packed = F.struct(on, *values)

    def cut(df):
        df = df.withColumn("_x", F.col(on).cast("double"))
        if len(splits) < 4:
            return df.withColumn("_b", F.lit(0.0))
        return Bucketizer(splits=splits, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(df)

    # One right row per (by, on): the largest value row stands for ties.
    r = right.groupBy(*by, on).agg(F.max(F.struct(*values)).alias("_s")).select(*by, on, "_s.*")
    r = cut(r).withColumn("_r", packed).withColumn("_side", F.lit(0))
    l = cut(left).withColumn("_side", F.lit(1))
    order = Window.partitionBy(*by).orderBy("_b")
    carry = (
        r.groupBy(*by, "_b").agg(F.max("_r").alias("_last"))
        .unionByName(l.select(*by, "_b").distinct().withColumn("_last", F.lit(None).cast(r.schema["_r"].dataType)))
        .groupBy(*by, "_b").agg(F.max("_last").alias("_last"))
        .select(*by, "_b", F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    )
    both = l.unionByName(r.select(*by, on, "_b", "_r", "_side"), allowMissingColumns=True)
    inside = Window.partitionBy(*by, "_b").orderBy("_x2", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_x2", F.col(on).cast("double"))
    scanned = both.withColumn("_hit", F.last("_r", ignorenulls=True).over(inside)).where(F.col("_side") == 1)
    null_safe = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "_b"]]
    out = scanned.alias("s").join(carry.alias("c"), null_safe, "left")
    hit = F.coalesce(F.col("s._hit"), F.col("c._carry"))
    return out.select(*[F.col(f"s.{c}") for c in left.columns], *[hit[v].alias(v) for v in values])


def compare_tables(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Row counts, id-set overlap, and per column the equal count and the largest absolute difference."""
    l, r = a.select(key, *columns).alias("l"), b.select(key, *columns).alias("r")
    j = l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "full")
    both = F.col(f"l.{key}").isNotNull() & F.col(f"r.{key}").isNotNull()
    aggs = [
        F.count(F.col(f"l.{key}")).alias("n_left"), F.count(F.col(f"r.{key}")).alias("n_right"), F.count_if(both).alias("n_both"),
    ]
    for c in columns:
        x, y = F.col(f"l.{c}"), F.col(f"r.{c}")
        aggs += [F.count_if(both & x.eqNullSafe(y)).alias(f"{c}_equal"), F.max(F.abs(x - y)).alias(f"{c}_max_abs")]
    return j.agg(*aggs)
