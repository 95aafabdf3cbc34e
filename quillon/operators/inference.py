"""Resampling intervals, named nulls and multiplicity control, all driven by row-key hashes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.special import sign_test_pvalue
from quillon.operators import ranking, replicates
from quillon.runtime import cut_lineage

N_BOOT = 200
MIN_REPLICATES = 10


def bootstrap(df: DataFrame, key: str, stats: Mapping[str, Callable[[Callable[..., Column]], Column]], n_boot: int = N_BOOT, seed=0, by: Sequence[str] = ()) -> DataFrame:
    """Replicates of statistics made of Poisson-weighted sums, without a copy of any row.

    Each statistic is a function of ``total``: total(column) stands for the weighted sum of the column, total() for the sum of the weights. The sums
    of all replicates come from one pass (:func:`replicates.replicate_sums`).
    """
    sums: list[Column] = []

    def total(column: Column | None = None) -> Column:
        if column is None:
            return F.col("w")
        sums.append(column)
        return F.col(f"s{len(sums) - 1}")

    made = {name: fn(total) for name, fn in stats.items()}
    reps = replicates.replicate_sums(df, key, sums, n_boot, seed, by)
    return reps.select(*by, "rep", *[c.alias(name) for name, c in made.items()])


def bootstrap_quantile(df: DataFrame, key: str, value: str, prob: float = 0.5, n_boot: int = N_BOOT, seed=0, by: Sequence[str] = ()) -> DataFrame:
    """Replicates of an exact quantile of the weighted rows."""
    return replicates.replicate_quantile(df, key, value, prob, n_boot, seed, by)


def intervals(reps: DataFrame, columns: Sequence[str], by: Sequence[str] = (), lo: float = 2.5, hi: float = 97.5) -> DataFrame:
    """Percentile interval per statistic; fewer than ten finite replicates give no interval."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.count(v).alias(f"_n{i}"), F.percentile(v, [lo / 100.0, hi / 100.0]).alias(f"_q{i}")]  # one value per replicate
    wide = cut_lineage(reps.groupBy(*by).agg(*aggs))
    out = None
    for i, c in enumerate(columns):
        enough = F.col(f"_n{i}") >= MIN_REPLICATES
        ends = [F.when(enough, F.get(f"_q{i}", F.lit(j))).alias(name) for j, name in enumerate(("ci_lo", "ci_hi"))]
        one = wide.where(F.col(f"_n{i}") > 0).select(*by, F.lit(c).alias("metric"), F.col(f"_n{i}").alias("n_rep"), *ends)
        out = one if out is None else out.union(one)
    return out


def basic_interval(point: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Pivotal interval [2 point - hi, 2 point - lo]."""
    return 2 * point - hi, 2 * point - lo


def shuffle_within(df: DataFrame, key: str, value: str, seed, out: str, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Permute a column among the rows where it is present: rows ranked by one hash take the value of the row with
    the same rank under another."""
    have = df.where(F.col(value).isNotNull()).select(*by, key, value)
    a = ranking.hash_order(have.select(*by, key), key, f"{seed}a", by, rows, "_r")
    b = ranking.hash_order(have, key, f"{seed}b", by, rows, "_r").select(*by, "_r", F.col(value).alias(out))
    moved = a.join(b, [*by, "_r"]).select(key, out)
    return df.join(moved, key, "left")


def sign_flip_null(df: DataFrame, key: str, delta: str, n_rep: int = N_BOOT, seed=0) -> DataFrame:
    """Median of randomly sign-flipped paired differences per replicate.

    A difference and its negative are two values of which a replicate weighs one, so the median is a weighted percentile of both.
    """
    both = [df.select(key, v.alias("median"), F.lit(kind).alias("_kind")) for v, kind in ((F.col(delta), "positive"), (-F.col(delta), "negative"))]
    return replicates.replicate_quantile(both[0].union(both[1]), key, "median", 0.5, n_rep, seed, weigh=F.col("_kind"))


def sign_test(df: DataFrame, delta: str, by: Sequence[str] = ()) -> DataFrame:
    """Positive share of paired differences and the two-sided sign test against one half."""
    c = df.where(F.col(delta).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(delta) > 0).alias("n_positive"))
    return c.withColumn("p_value", sign_test_pvalue("n_positive", "n"))


def bonferroni(df: DataFrame, item: str, p: str, n_labels: int) -> DataFrame:
    """Smallest p over an item's labels times the number of labels, at most one."""
    return df.groupBy(item).agg(F.least(F.lit(1.0), F.min(p) * F.lit(n_labels)).alias("p_item"))


def bh_qvalues(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "q", chunk: int = 100_000) -> DataFrame:
    """Benjamini-Hochberg q per distinct (by, p): the smallest p m / rank over all p at or above.

    Ranks come from :func:`ranking.value_ranks`; the suffix minimum is taken inside chunks of the ranking, with
    the minimum of all later chunks carried in from a table of one row per chunk.
    """
    by = list(by)
    r = ranking.value_ranks(df, p, by).withColumn("_x", F.col(p) * F.col("total") / (F.col("before") + F.col("n")))
    r = r.withColumn("_c", F.floor(F.col("before") / F.lit(chunk)))
    later = Window.partitionBy(*by).orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = r.groupBy(*by, "_c").agg(F.min("_x").alias("_m")).select(*by, "_c", F.min("_m").over(later).alias("_carry"))
    inside = Window.partitionBy(*by, "_c").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    j = r.withColumn("_s", F.min("_x").over(inside)).join(carry, [*by, "_c"])
    return j.select(*by, p, F.least(F.lit(1.0), F.least("_s", "_carry")).alias(out))


def ks_uniform(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Kolmogorov distance of a value from the uniform distribution on [0, 1] per group, from ranks per value."""
    r = ranking.value_ranks(df, value, by)
    above = (F.col("before") + F.col("n")) / F.col("total") - F.col(value)
    below = F.col(value) - F.col("before") / F.col("total")
    return r.groupBy(*by).agg(F.max("total").alias("n"), F.max(F.greatest(above, below)).alias("d"))
