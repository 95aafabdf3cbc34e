"""Exact ranks, percentiles and hash-ordered numbering that never put a whole hot group in one task.

The shared shape: count equal values first (map-side combine), cut the value axis into buckets, take running
totals over the few buckets of each group, then rank inside (group, bucket). A group holding a third of all
rows is thus spread over a third of the buckets. The plan is the same at every size; a short column has one bucket.
NULL values are left out, NULL group keys form a group, and NaN ranks above every number, as Spark orders it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon import runtime
from quillon.functions import hashing


COPIES = 100_000  # copies of one value laid out by one row
SKETCH = 10_000  # accuracy of the sketch that brackets percentiles: its rank error is one in so many rows
SLACK = 4  # rank errors of the sketch that a bracket reaches to either side
FEW = 4_096  # values up to which a group is kept whole
TAKE_ROWS = 1_000  # rows a take-ordered may keep per partition without a filter before it


def _edges(df: DataFrame, value: str, buckets: int) -> list[float]:
    """Bounds of the ranges; NaN is not looked at here and gets a range of its own."""
    if buckets < 2:
        return [float("-inf"), float("inf")]
    df = df.where(~F.isnan(F.col(value).cast("double")))
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(value, probs, 20 * buckets).alias("e")).first()
    inner = sorted({float(x) for x in (row["e"] or [])} - {float("-inf"), float("inf")})
    return [float("-inf"), *inner, float("inf")]


def value_ranks(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    weight: Column | None = None,
    rows: int | None = None,
) -> DataFrame:
    """One row per (by, value): ``n`` copies, ``before`` rows with smaller values, ``total`` rows in the group.

    ``weight`` counts each row several times (bootstrap weights). NULL values are left out.
    """
    by = list(by)
    one = F.lit(1).cast("long") if weight is None else weight.cast("long")
    src = df.where(F.col(value).isNotNull()).withColumn("_w", one).where(F.col("_w") > 0)
    rows = df.count() if rows is None else rows
    splits = _edges(src, value, runtime.bucket_count(rows, df.sparkSession))
    return _rank_counts(src.groupBy(*by, value).agg(F.sum("_w").alias("n")), value, by, splits)


def _rank_counts(counts: DataFrame, value: str, by: Sequence[str], splits: Sequence[float]) -> DataFrame:
    """``before`` and ``total`` for a table of distinct (by, value) with their ``n``; further columns are kept.

    Without inner splits the whole table is as short as one range, so groups are ranked as they are.
    """
    by = list(by)
    if len(splits) < 3:
        group = Window.partitionBy(*by)
        running = F.sum("n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        return counts.select("*", (running - F.col("n")).alias("before"), F.sum("n").over(group).alias("total"))
    binned = counts.withColumn("_v", F.col(value).cast("double"))
    binned = Bucketizer(splits=list(splits), inputCol="_v", outputCol="_b", handleInvalid="keep").transform(binned).drop("_v")
    per_bucket = binned.groupBy(*by, "_b").agg(F.sum("n").alias("_bn"))
    order = Window.partitionBy(*by).orderBy("_b")
    whole = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *by,
        "_b",
        (F.sum("_bn").over(order) - F.col("_bn")).alias("_off"),
        F.sum("_bn").over(whole).alias("total"),
    )
    inside = Window.partitionBy(*by, "_b").orderBy(value)
    left = binned.withColumn("_in", F.sum("n").over(inside) - F.col("n"))
    null_safe = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_b"]]
    joined = left.alias("l").join(offsets.alias("r"), null_safe)
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in counts.columns], (F.col("_in") + F.col("_off")).alias("before"), "total")


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Average-tie rank per distinct (by, value), counted from one."""
    r = value_ranks(df, value, by, rows=rows)
    return r.withColumn("avg_rank", F.col("before") + (F.col("n") + 1) / 2.0)


def with_average_rank(
    df: DataFrame, value: str, out: str, by: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """Attach the average-tie rank of ``value`` within ``by`` to every row; NULL stays NULL."""
    by = list(by)
    ranks = average_ranks(df, value, by, rows=rows)
    ranks = ranks.select(*[F.col(c).alias(f"_r_{i}") for i, c in enumerate(by)], F.col(value).alias("_r_value"), F.col("avg_rank").alias(out))
    same = F.col(value) == F.col("_r_value")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{i}"))
    return df.join(ranks, same, "left").select(*df.columns, out)


def ecdf(df: DataFrame, value: str, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Every copy of a value with its position i in the sorted group and ``(i - 0.5) / total``."""
    rows = df.count() if rows is None else rows
    r = value_ranks(df, value, by, rows=rows)
    # Copies of a value are laid out in slices, so a value shared by a third of all rows is no single long array.
    part = r.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    part = runtime.spread(part)
    first = F.col("_s") * COPIES + 1
    copies = part.withColumn("_j", F.explode(F.sequence(first, F.least(first + (COPIES - 1), F.col("n")))))
    return copies.select(
        *by, value, (F.col("before") + F.col("_j")).alias("i"),
        ((F.col("before") + F.col("_j") - 0.5) / F.col("total")).alias("cdf"),
    )


def null_safe_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equally named columns, NULL keys being a group like any other; a broadcast hint of the right side holds."""
    if not by:
        return left.crossJoin(right)  # one row
    other = right.select(*[F.col(c).alias(f"_k_{c}") if c in by else F.col(c) for c in right.columns])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by])
    out = left.join(other, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_k_{c}" for c in by])


def picks(ranks: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], names: Sequence[str], certain: Column | None = None, further: Mapping[str, Column] | None = None) -> DataFrame:
    """Linear-interpolated percentiles out of ranked values, with further aggregates; ``_sure`` tells whether every value that was read is ``certain``."""
    aggs, sure = [], []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        covers = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
        aggs += [
            F.max(F.when(covers(lo), F.col(value).cast("double"))).alias(f"_lo{i}"),
            F.max(F.when(covers(hi), F.col(value).cast("double"))).alias(f"_hi{i}"),
            F.max(pos - lo).alias(f"_f{i}"),
        ]
        if certain is not None:
            sure.append(F.min(F.when(covers(lo) | covers(hi), certain)))
    out = ranks.groupBy(*by).agg(*aggs, *[c.alias(f"_c{i}") for i, c in enumerate(sure)], *[c.alias(k) for k, c in (further or {}).items()])
    return out.select(
        *by, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(n) for i, n in enumerate(names)],
        *(further or {}), *([F.coalesce(reduce(and_, [F.col(f"_c{i}") for i in range(len(sure))]), F.lit(False)).alias("_sure")] if sure else []),
    )


def ranked_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), weight: Column | None = None, rows: int | None = None, names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact linear-interpolated percentiles per group by ranking every distinct value; rows may be weighted."""
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    rows = df.count() if rows is None else rows
    return picks(value_ranks(df, value, by, weight=weight, rows=rows), value, probs, list(by), names)


def brackets(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``_n`` values and a pair ``_lo{i}``, ``_hi{i}`` that most likely encloses the ranks next to every wanted percentile.

    The pairs come from a mergeable sketch, read SLACK of its rank errors below and above the rank. Groups of few values or with NaN get open pairs; NaN as
    an upper end is open, since it is above every number.
    """
    v = F.col(value).cast("double")
    eps = SLACK / SKETCH
    asked = [min(1.0, max(0.0, x)) for p in probs for x in (p - eps, p + eps)]
    s = df.groupBy(*by).agg(F.count(v).alias("_n"), F.count_if(F.isnan(v)).alias("_nan"), F.percentile_approx(F.when(~F.isnan(v), v), asked, SKETCH).alias("_s"))
    open_ = (F.col("_n") <= FEW) | (F.col("_nan") > 0)
    pairs = []
    for i, p in enumerate(probs):
        pairs.append(F.when(open_ | F.lit(p - eps <= 0), F.lit(float("-inf"))).otherwise(F.get("_s", F.lit(2 * i))).alias(f"_lo{i}"))
        pairs.append(F.when(open_ | F.lit(p + eps >= 1), F.lit(float("nan"))).otherwise(F.get("_s", F.lit(2 * i + 1))).alias(f"_hi{i}"))
    return s.select(*by, "_n", *pairs)


def reduced_counts(df: DataFrame, value: str, bounds: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """Distinct values inside the pairs with their counts (``_sure``), and one row for all values of each gap between them, in the gap's place.

    ``bounds`` is a stored table of one row per group, so Spark knows its bytes and broadcasts it only under its own threshold.
    """
    joined = null_safe_join(df.where(F.col(value).isNotNull()).select(*by, value), bounds if by else F.broadcast(bounds), by)
    v = F.col(value).cast("double")
    inside = reduce(or_, [(v >= F.col(lo)) & (v <= F.col(hi)) for lo, hi in pairs])
    gap = reduce(add, [(v > F.col(hi)).cast("int") for _, hi in pairs])
    counts = joined.groupBy(*by, F.when(inside, F.col(value)).alias("_v"), F.when(~inside, gap).alias("_g")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("_m"))
    return counts.select(*by, F.coalesce("_v", "_m").alias(value), F.col("_v").isNotNull().alias("_sure"), "n")


def rank_reduced(reduced: DataFrame, value: str, by: Sequence[str], rows: int | None = None) -> DataFrame:
    """Ranks of a table of :func:`reduced_counts`."""
    rows = reduced.count() if rows is None else rows
    return _rank_counts(reduced, value, by, _edges(reduced, value, runtime.bucket_count(rows, reduced.sparkSession)))


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    weight: Column | None = None,
    rows: int | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact linear-interpolated percentiles per group, one column per probability.

    A sketch gives a bracket of values around each wanted rank (one pass); a second pass counts what lies below, between and above the brackets
    and keeps the distinct values inside them, about 2 SLACK / SKETCH of the rows per percentile. Ranks are exact counts, so a percentile is proven when the values it
    reads are inside a bracket. Groups for which a bracket missed are ranked in full; so are weighted rows, and a column no longer than one range (see :func:`value_ranks`).
    """
    by, probs = list(by), list(probs)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    short = lambda n: runtime.bucket_count(n, df.sparkSession) == 1
    if weight is not None or (rows is not None and short(rows)):
        return ranked_quantiles(df, value, probs, by, weight, rows, names)
    bounds = runtime.cut_lineage(brackets(df, value, probs, by))
    total = bounds.agg(F.sum("_n")).first()[0] or 0
    if short(total):
        runtime.discard(bounds)
        return ranked_quantiles(df, value, probs, by, None, total, names)
    pairs = [(f"_lo{i}", f"_hi{i}") for i in range(len(probs))]
    reduced = runtime.cut_lineage(reduced_counts(df, value, bounds, pairs, by))
    out = runtime.cut_lineage(picks(rank_reduced(reduced, value, by), value, probs, by, names, F.col("_sure")))
    runtime.discard(bounds, reduced)
    missed = out.where(~F.col("_sure"))
    sure = out.where("_sure").drop("_sure")
    if missed.isEmpty():
        return sure
    again = null_safe_join(df, missed.select(*by), by, "left_semi") if by else df
    return sure.unionByName(ranked_quantiles(again, value, probs, by, None, rows, names))


def quantiles_of(
    df: DataFrame, values: Sequence[str], probs: Sequence[float], names: Sequence[str] | None = None
) -> DataFrame:
    """Percentiles of several columns in one pass: rows (metric, q...)."""
    pairs = [F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.metric", "p.value")
    return quantiles(long, "value", probs, ["metric"], names=names)


def hash_order(
    df: DataFrame,
    key: str,
    seed,
    by: Sequence[str] = (),
    rows: int | None = None,
    out: str = "rn",
) -> DataFrame:
    """Number the rows of each group in seeded hash order (ties by key).

    Hash values are uniform, so equal-width slices of the hash range are equal-sized buckets and a hot group
    is split over all of them; no edge search is needed.
    """
    by = list(by)
    h = df.withColumn("_h", hashing.hash32(seed, key))
    rows = df.count() if rows is None else rows
    buckets = runtime.bucket_count(rows, df.sparkSession)
    h = h.withColumn("_b", F.floor(F.col("_h") / F.lit(hashing.SPAN / buckets)).cast("int"))
    order = Window.partitionBy(*by).orderBy("_b")
    offsets = (
        h.groupBy(*by, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, "_b", (F.sum("_n").over(order) - F.col("_n")).alias("_off"))
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_h", key)
    numbered = h.withColumn("_in", F.row_number().over(inside))
    null_safe = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_b"]]
    joined = numbered.alias("l").join(offsets.alias("r"), null_safe)
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns], (F.col("_in") + F.col("_off")).cast("long").alias(out)
    )


def sample_n(df: DataFrame, key: str, n: int, seed) -> DataFrame:
    """Seeded sample of n rows without replacement: the n smallest hashes (a take-ordered, not a full sort).

    For larger n, rows whose hash is far above the n-th smallest are filtered out first (hashes are uniform, so the
    limit is ten deviations away); should the filter ever leave too few rows, it is not used.
    """
    if n > TAKE_ROWS:
        total = df.count()
        limit = hashing.SPAN * (n + 10.0 * n**0.5 + 100.0) / max(total, 1)
        if limit < hashing.SPAN:
            near = df.where(hashing.hash32(seed, key) < F.lit(int(limit)))
            if near.count() >= n:
                df = near
    return df.withColumn("_h", hashing.hash32(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, out: str = "rank") -> DataFrame:
    """k first rows per group. Spark prunes each input partition to k rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key by an explicit order, as a combinable aggregate instead of a window."""
    by = list(by)
    rest = [c for c in df.columns if c not in by]
    ranks = [F.col(o) if isinstance(o, str) else o for o in order]
    best = F.min_by(F.struct(*rest), F.struct(*[r.alias(f"o{i}") for i, r in enumerate(ranks)]))
    return df.groupBy(*by).agg(best.alias("_best")).select(*by, "_best.*")
