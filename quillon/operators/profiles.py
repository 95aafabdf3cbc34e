"""Aggregations: counts, spreads, binned and robust profiles, histograms, weighted statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon import runtime
from quillon.functions.scalars import col
from quillon.operators import ranking


def uniqueness(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows, distinct keys, repeated rows and the range of a value."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return per_key.agg(
        F.sum("n").alias("n_rows"), F.count(key).alias("n_unique"),
        (F.sum("n") - F.count(F.lit(1))).alias("n_duplicate"), F.min("lo").alias("min"), F.max("hi").alias("max"),
    )


def distinct_count_histogram(df: DataFrame, key: str, item: str) -> DataFrame:
    """How many keys have each number of distinct items (chain-length distribution)."""
    per_key = df.groupBy(key).agg(F.count_distinct(item).alias("length"))
    return per_key.groupBy("length").agg(F.count(F.lit(1)).alias("n_keys"))


def group_spread(df: DataFrame, key: str, value: str, cut: float, min_rows: int = 2) -> DataFrame:
    """log10(max/min) per key with at least ``min_rows`` rows: median, p95 and the share above a cut."""
    per_key = df.groupBy(key).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.count(F.lit(1)).alias("n"))
    spread = per_key.where((F.col("n") >= min_rows) & (F.col("lo") > 0)).select(F.log10(F.col("hi") / F.col("lo")).alias("spread"))
    q = ranking.quantiles(spread, "spread", [0.5, 0.95], names=["median", "p95"])
    share = spread.agg(F.count(F.lit(1)).alias("n_groups"), F.avg((F.col("spread") > cut).cast("double")).alias("share_above"))
    return share.crossJoin(F.broadcast(q))  # both sides are one row


def bin_index(c, lo: float, width: float) -> Column:
    """Index of the half-open bin [lo + i*width, lo + (i+1)*width)."""
    return F.floor((col(c) - F.lit(lo)) / F.lit(width)).cast("int")


def edge_bin(c, edges: Sequence[float], closed_last: bool = False) -> Column:
    """Index of the bin of an explicit edge list, NULL outside; the last edge optionally belongs to the last bin."""
    x = col(c)
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        upper = (x <= edges[i + 1]) if (closed_last and i == len(edges) - 2) else (x < edges[i + 1])
        out = F.when((x >= edges[i]) & upper, F.lit(i)).otherwise(out)
    return out


def binned_profile(
    df: DataFrame,
    bin_col: Column,
    value: str,
    probs: Mapping[str, float],
    extra: Mapping[str, Column] | None = None,
    min_rows: int = 1,
) -> DataFrame:
    """Per bin: row count, exact percentiles and any further aggregates. Rows outside all bins are left out."""
    binned = df.withColumn("bin", bin_col).where(F.col("bin").isNotNull() & F.col(value).isNotNull())
    basic = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in (extra or {}).items()])
    q = ranking.quantiles(binned, value, list(probs.values()), ["bin"], names=list(probs))
    return basic.where(F.col("n") >= min_rows).join(q, "bin")


def quantile_edges(df: DataFrame, value: str, n_bins: int) -> list[float]:
    """n_bins + 1 exact quantile edges (a handful of numbers)."""
    row = ranking.quantiles(df, value, [i / n_bins for i in range(n_bins + 1)]).first()
    return [row[i] for i in range(n_bins + 1)]


def quantile_bin(df: DataFrame, value: str, n_bins: int, out: str = "bin") -> DataFrame:
    """Bin by comparing with the exact quantile edges, so equal values share a bin; the last bin is closed."""
    edges = quantile_edges(df, value, n_bins)
    return df.withColumn(out, edge_bin(value, edges, closed_last=True))


def histogram(df: DataFrame, value: str, lo: float, width: float, n_bins: int, volume: float = 1.0) -> DataFrame:
    """Counts and density per unit volume and width on fixed bins; empty bins are present, last edge closed."""
    top = lo + n_bins * width
    x = F.col(value)
    b = F.when(x == F.lit(top), F.lit(n_bins - 1)).otherwise(bin_index(x, lo, width))
    counts = df.where((x >= lo) & (x <= top)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width)).alias("center"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        (F.coalesce("n", F.lit(0)) / F.lit(volume * width)).alias("density"),
    )


def histogram_2d(df: DataFrame, xbin: Column, ybin: Column, target_total: float) -> DataFrame:
    """Occupied cells of a 2-D histogram with counts scaled to a target total of all rows given."""
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    cells = (
        df.select(xbin.alias("xbin"), ybin.alias("ybin")).where(F.col("xbin").isNotNull() & F.col("ybin").isNotNull())
        .groupBy("xbin", "ybin").agg(F.count(F.lit(1)).alias("n"))
    )
    return cells.crossJoin(F.broadcast(total)).select(
        "xbin", "ybin", "n", (F.col("n") * F.lit(float(target_total)) / F.col("_t")).alias("target")
    )


def circular_occupancy(df: DataFrame, angle: str, period: float, n_bins: int) -> DataFrame:
    """Share of occupied bins and the smallest and largest count on a circular binning."""
    b = F.floor(F.pmod(F.col(angle), F.lit(period)) / F.lit(period / n_bins)).cast("int")
    counts = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    full = spine.join(counts, "bin", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return full.agg(
        F.avg((F.col("n") > 0).cast("double")).alias("occupied"), F.min("n").cast("long").alias("min_n"), F.max("n").cast("long").alias("max_n")
    )


def weighted_summary(df: DataFrame, by: Sequence[str], value: Column, weight) -> DataFrame:
    """Weighted mean, raw mean and effective sample size (sum w)^2 / sum w^2 per stratum."""
    w = col(weight)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(w * value) / F.sum(w)).alias("weighted_mean"), F.avg(value).alias("raw_mean"),
        (F.pow(F.sum(w), 2) / F.sum(w * w)).alias("ess"),
    )


def robust_scatter(df: DataFrame, residual: str, by: Sequence[str] = (), outlier: float = 0.15, min_rows: int = 1) -> DataFrame:
    """Median, 1.4826 x median absolute deviation, outlier share and RMS of a residual per group.

    Two scans: a sketch of the residual brackets the median and, read as a distribution function, the median deviation d; the second scan counts rows and keeps
    only values near the median and near median - d and median + d. Both medians are exact ranks of these, and proven if they lie inside their brackets;
    other groups are ranked in full.
    """
    by = list(by)
    rows = df.where(F.col(residual).isNotNull()).select(*by, residual)
    bounds = runtime.cut_lineage(_scatter_brackets(rows, residual, by, outlier))
    pairs = [("_a1", "_a2"), ("_m1", "_m2"), ("_b1", "_b2")]
    reduced = runtime.cut_lineage(ranking.reduced_counts(rows, residual, bounds, pairs, by))
    n_kept = reduced.count()
    med = ranking.picks(ranking.rank_reduced(reduced, residual, by, n_kept), residual, [0.5], by, ["bias"], F.col("_sure")).withColumnRenamed("_sure", "_sure_bias")
    both = ranking.null_safe_join(reduced, ranking.null_safe_join(bounds.select(*by, "_a2", "_m2", "_d1", "_d2"), med, by), by)
    # Gaps next to the median hold smaller deviations than the bracket, outer gaps larger ones.
    x = F.col(residual).cast("double")
    near = (x > F.col("_a2")) & (x < F.col("_m2") + F.col("_d2"))
    dev = F.when(F.col("_sure"), F.abs(x - F.col("bias"))).when(near, F.lit(-1.0)).otherwise(F.lit(float("inf")))
    sure = F.col("_sure") & F.col("_sure_bias") & (F.col("_dev") >= F.col("_d1")) & ((F.col("_dev") <= F.col("_d2")) | F.isnan("_d2"))
    dev = both.select("*", dev.alias("_dev")).groupBy(*by, "_dev").agg(F.sum("n").alias("n"), F.min(sure).alias("_sure"), F.max("bias").alias("_bias"))
    found = ranking.picks(ranking.rank_reduced(dev, "_dev", by, n_kept), "_dev", [0.5], by, ["mad"], F.col("_sure"), {"bias": F.max("_bias")})
    found = runtime.cut_lineage(found).where("_sure").drop("_sure")
    basic = bounds.select(*by, F.col("_n").alias("n"), "outlier_share", "rms")
    missed = ranking.null_safe_join(basic.select(*by), found.select(*by), by, "left_anti") if by else basic.select("n").where(F.lit(found.isEmpty()))
    if not missed.isEmpty():
        again = ranking.null_safe_join(rows, missed, by, "left_semi") if by else rows
        m = ranking.ranked_quantiles(again, residual, [0.5], by, names=["bias"])
        d = ranking.null_safe_join(again, runtime.broadcast_checked(m) if by else F.broadcast(m), by).withColumn("_dev", F.abs(F.col(residual) - F.col("bias")))
        found = found.unionByName(ranking.null_safe_join(m, ranking.ranked_quantiles(d, "_dev", [0.5], by, names=["mad"]), by))
    out = ranking.null_safe_join(basic.where(F.col("n") >= min_rows), found, by)
    return out.select(*by, "n", "bias", (1.4826 * F.col("mad")).alias("sigma_mad"), "outlier_share", "rms")


def _scatter_brackets(rows: DataFrame, residual: str, by: Sequence[str], outlier: float) -> DataFrame:
    """Per group: the plain aggregates, and brackets of the median (``_m``), of the median deviation (``_d``) and of the values that far below (``_a``) and above (``_b``)."""
    x = F.col(residual).cast("double")
    steps = 1000
    grid = [i / steps for i in range(steps + 1)]
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.isnan(x)).alias("_nan"), F.percentile_approx(F.when(~F.isnan(x), x), grid, ranking.SKETCH).alias("_g"),
        F.avg((F.abs(F.col(residual)) > outlier).cast("double")).alias("outlier_share"), F.sqrt(F.avg(F.pow(F.col(residual), 2))).alias("rms"),
    )
    s = s.withColumn("_m1", F.get("_g", F.lit(steps // 2 - 1))).withColumn("_m2", F.get("_g", F.lit(steps // 2 + 1)))
    # Counting grid points within d of m1 and m2 bounds the share of deviations up to d, for every distance d of a grid point.
    reach = lambda m: F.transform("_g", lambda v: F.abs(v - F.col(m)))
    s = s.withColumn("_e1", F.array_sort(reach("_m1"))).withColumn("_e2", F.array_sort(reach("_m2")))
    width = F.col("_m2") - F.col("_m1")
    low = F.greatest(F.lit(0.0), F.least(F.get("_e1", F.lit(steps // 2 - 3)), F.get("_e2", F.lit(steps // 2 - 3))) - width)
    s = s.withColumn("_d1", low).withColumn("_d2", F.greatest(F.get("_e1", F.lit(steps // 2 + 3)), F.get("_e2", F.lit(steps // 2 + 3))) + width)
    open_ = (F.col("_n") <= ranking.FEW) | (F.col("_nan") > 0)
    ends = {
        "_m1": (F.col("_m1"), "-inf"), "_m2": (F.col("_m2"), "nan"), "_a1": (F.col("_m1") - F.col("_d2"), "-inf"), "_a2": (F.col("_m2") - F.col("_d1"), "nan"),
        "_b1": (F.col("_m1") + F.col("_d1"), "-inf"), "_b2": (F.col("_m2") + F.col("_d2"), "nan"), "_d1": (F.col("_d1"), "0"), "_d2": (F.col("_d2"), "nan"),
    }
    return s.select(*by, "_n", "outlier_share", "rms", *[F.when(open_, F.lit(float(o))).otherwise(c).alias(k) for k, (c, o) in ends.items()])


def convention_difference(df: DataFrame, new: str, old: str, base: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Relative difference of two versions of one quantity, and the class share under each."""
    by = list(by)
    hi, lo = F.greatest(new, old), F.least(new, old)
    rel = F.when(hi > 0, (hi - lo) / hi).otherwise(F.lit(0.0))
    d = df.withColumn("_rel", rel)
    pos = F.col(base) > 0
    basic = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hi == 0).alias("both_zero"),
        F.avg(F.when(F.col("_rel") > 0, (F.col(new) < F.col(old)).cast("double"))).alias("new_lower_of_differing"),
        F.avg((F.col("_rel") > 0.05).cast("double")).alias("share_gt_5pct"),
        F.avg((F.col("_rel") > 0.20).cast("double")).alias("share_gt_20pct"),
        F.avg((F.col("_rel") > 0.50).cast("double")).alias("share_gt_2x"),
        F.avg(F.when(pos, (F.col(new) / F.col(base) < threshold).cast("double"))).alias("class_share_new"),
        F.avg(F.when(pos, (F.col(old) / F.col(base) < threshold).cast("double"))).alias("class_share_old"),
    )
    q = ranking.quantiles(d, "_rel", [0.5, 0.9], by, names=["median_rel", "p90_rel"])
    return basic.join(q, by) if by else basic.crossJoin(F.broadcast(q))


def offset_by_colour(df: DataFrame, offset: str, colour: str, n_bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """Offset profile over equal colour bins between p1 and p99, and the residual scatter after subtracting
    each bin's median. Returns (per-bin table, one-row summary)."""
    lo, hi = ranking.quantiles(df, colour, [0.01, 0.99]).first()
    edges = [lo + (hi - lo) * i / n_bins for i in range(n_bins + 1)]
    binned = df.withColumn("bin", edge_bin(colour, edges)).where(F.col(offset).isNotNull())
    inside = binned.where(F.col("bin").isNotNull())
    med = ranking.quantiles(inside, offset, [0.5], ["bin"], names=["median_offset"])
    width = (hi - lo) / n_bins
    per_bin = (
        inside.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(offset).alias("std"))
        .join(med, "bin").withColumn("center", F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width))
    )
    resid = inside.join(F.broadcast(med), "bin").agg(F.stddev_pop(F.col(offset) - F.col("median_offset")).alias("residual_std"))  # n_bins rows
    whole = binned.agg(F.stddev_pop(offset).alias("std"))
    q = ranking.quantiles(binned, offset, [0.05, 0.5, 0.95], names=["p5", "median", "p95"])
    return per_bin, whole.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(resid))


def with_distinct_count(df: DataFrame, key: str, item: str, out: str) -> DataFrame:
    """Attach each key's number of distinct items to its rows by an aggregate and a join, never a set per window."""
    counts = df.select(key, item).distinct().groupBy(key).agg(F.count(item).alias(out))
    return df.join(counts, key, "left")


def cumulative_components(df: DataFrame, order: str, variance: str, shares: Sequence[float]) -> DataFrame:
    """Number of leading components needed for each share of the variance; input is one row per component."""
    w = Window.orderBy(F.col(variance).desc(), order)  # rows = vector length, not table size
    cum = df.select(
        F.row_number().over(w).alias("k"), F.sum(variance).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
        F.sum(variance).over(Window.partitionBy(F.lit(1))).alias("t"),
    )
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return cum.select("k", "c", "t", wanted).where(F.col("c") >= F.col("share") * F.col("t")).groupBy("share").agg(F.min("k").alias("n_components"))


def largest_gaps(df: DataFrame, value: str, m: int) -> DataFrame:
    """The m largest values and the gap from each to the next one down."""
    head = df.select(value).orderBy(F.col(value).desc()).limit(m + 1)
    w = Window.orderBy(F.col(value).desc())  # m + 1 rows
    return head.select(F.row_number().over(w).alias("i"), F.col(value), (F.col(value) - F.lead(value).over(w)).alias("gap")).where(F.col("i") <= m)
