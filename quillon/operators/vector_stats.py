"""Statistics of vector columns: per-dimension moments, z-scores, second-moment matrices, components.

Vectors are never gathered: per-dimension statistics are one combinable JVM aggregate, second moments are summed
per partition by BLAS and added up by matrix row, and the driver only sees d x d results.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import vectors
from quillon.operators import kernels, ranking

EPS = 1e-8


def dim_stats(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """Row count, mean and population standard deviation per dimension, as arrays (one row per group).

    Vectors that are NULL or hold NULL, NaN or infinite components are left out, and not counted.
    """
    df = df.where(vectors.usable(vec))
    s = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(vectors.as_double(vec)))
    out = df.groupBy(*by).agg(s.alias("_s"))
    n = F.col("_s.count")
    scale = F.when(n > 1, (n - 1) / n).otherwise(F.lit(0.0))  # the summary's variance divides by n - 1
    var = vector_to_array(F.col("_s.variance"))
    return out.select(
        *by, n.alias("n"), vector_to_array(F.col("_s.mean")).alias("mean"),
        F.transform(var, lambda v: F.sqrt(v * scale)).alias("std"),
    )


def zscore(df: DataFrame, vec: str, stats: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """(x - mean) / (std + 1e-8) per dimension, with the table's own statistics or another table's."""
    one = (dim_stats(df, vec) if stats is None else stats).select(F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    z = F.transform(
        F.arrays_zip(vectors.as_double(vec).alias("x"), F.col("_mean").alias("m"), F.col("_std").alias("s")),
        lambda t: (t["x"] - t["m"]) / (t["s"] + F.lit(EPS)),
    )
    joined = df.crossJoin(F.broadcast(one))  # a global aggregate: exactly one row
    return joined.withColumn(out or vec, z).drop("_mean", "_std")


def by_dimension(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form (dim, mean, std) of the statistics arrays."""
    zipped = F.arrays_zip(F.col("mean").alias("mean"), F.col("std").alias("std"))
    return stats.select(*by, F.posexplode(zipped).alias("dim", "_z")).select(*by, "dim", F.col("_z.mean").alias("mean"), F.col("_z.std").alias("std"))


def vector_profile(df: DataFrame, vec: str) -> DataFrame:
    """Bad-value counts, norm statistics and the spread of per-dimension standard deviations."""
    is_nan = F.size(F.filter(vectors.as_double(vec), lambda x: F.isnan(x)))
    is_inf = F.size(F.filter(vectors.as_double(vec), lambda x: F.abs(x) == F.lit(float("inf"))))
    good = df.where(~vectors.has_bad_value(vec))
    basic = df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size(vec)).alias("dims"), F.sum(is_nan).alias("n_nan"), F.sum(is_inf).alias("n_inf"))
    norms = good.agg(F.avg(vectors.norm(vec)).alias("norm_mean"), F.stddev_pop(vectors.norm(vec)).alias("norm_std"))
    spread = dim_stats(good, vec).select(
        F.array_min("std").alias("dim_std_min"), F.array_max("std").alias("dim_std_max"),
        (F.array_max("std") / F.array_min("std")).alias("dim_std_ratio"),
    )
    return basic.crossJoin(F.broadcast(norms)).crossJoin(F.broadcast(spread))  # three one-row tables


def group_means(df: DataFrame, by: Sequence[str], vec: str) -> DataFrame:
    return dim_stats(df, vec, by).select(*by, "n", "mean")


def mean_difference(df: DataFrame, positive: Column, negative: Column, vec: str) -> DataFrame:
    """Unit direction from the mean of the negative rows to the mean of the positive rows, in one pass."""
    side = F.when(positive, "p").when(negative, "n")
    both = positive & negative
    sides = F.when(both, F.array(F.lit("p"), F.lit("n"))).otherwise(F.array_compact(F.array(side)))
    means = df.withColumn("_side", F.explode(sides)).groupBy("_side").agg(
        Summarizer.mean(array_to_vector(vectors.as_double(vec))).alias("m")
    )
    one = means.agg(F.max(F.when(F.col("_side") == "p", vector_to_array("m"))).alias("p"), F.max(F.when(F.col("_side") == "n", vector_to_array("m"))).alias("q"))
    return one.select(vectors.normalise(vectors.subtract("p", "q")).alias("direction"))


# ---- second moments -----------------------------------------------------------------------------------------

MOMENT_ROW = "i int, row array<double>"


def moment_rows(
    df: DataFrame, vec: str | None, extra: Sequence[str] = (), by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Rows of the matrix sum w a a^T with a = [1, vector, extra...], per group.

    Each partition adds its rows with BLAS and emits one matrix; the matrices are added by row index. A partition
    that meets many groups emits early, so its memory stays bounded. Rows whose vector is NULL or holds NULL, NaN or
    infinite components are left out.
    """
    if vec:
        df = df.where(vectors.usable(vec))
    by, extra = list(by), list(extra)
    cols = by + ([vec] if vec else []) + extra + ([weight] if weight else [])
    fields = [df.schema[c] for c in by]
    schema = T.StructType(fields + [T.StructField("i", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType()))])

    def emit(acc, types):
        for key, m in acc.items():
            n = m.shape[0]
            arrays = [pa.array([v] * n, type=t) for t, v in zip(types, key)]
            names = by + ["i", "row"]
            arrays += [pa.array(np.arange(n, dtype=np.int32)), kernels.lists(m)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    def partial(batches):
        acc: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for b in batches:
            if b.num_rows == 0:
                continue
            types = [b.schema.field(c).type for c in by]
            parts = [np.ones((b.num_rows, 1))]
            if vec:
                parts.append(kernels.matrix(b.column(vec)))
            parts += [kernels.numbers(b, c)[:, None] for c in extra]
            a = np.hstack(parts)
            w = kernels.numbers(b, weight)[:, None] if weight else None
            if not by:
                acc[()] = acc.get((), 0.0) + a.T @ (a * w if weight else a)
                continue
            keys = list(zip(*[b.column(c).to_pylist() for c in by]))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                groups.setdefault(key, []).append(i)
            for key, idx in groups.items():
                sub = a[idx]
                acc[key] = acc.get(key, 0.0) + sub.T @ (sub * w[idx] if weight else sub)
            if len(acc) > 32:
                yield from emit(acc, types)
                acc = {}
        yield from emit(acc, types)

    partials = df.select(*cols).mapInArrow(partial, schema)
    total = Summarizer.sum(array_to_vector("row"))
    return partials.groupBy(*by, "i").agg(total.alias("_v")).select(*by, "i", vector_to_array("_v").alias("row"))


def moment_matrix(df: DataFrame, vec: str | None, extra: Sequence[str] = (), weight: str | None = None) -> np.ndarray:
    """The moment matrix on the driver: (1 + d + extras) squared numbers, whatever the row count."""
    rows = moment_rows(df, vec, extra, weight=weight).collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def gram(df: DataFrame, vec: str) -> DataFrame:
    """Uncentred second moments (i, j, value) of a vector column."""
    rows = moment_rows(df, vec).where(F.col("i") > 0)
    return rows.select((F.col("i") - 1).alias("i"), F.posexplode("row").alias("_j", "value")).where(F.col("_j") > 0).select(
        "i", (F.col("_j") - 1).alias("j"), "value"
    )


def covariance(m: np.ndarray, d: int, ddof: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of the d vector dimensions from a moment matrix."""
    n = m[0, 0]
    mean = m[0, 1 : 1 + d] / n
    return mean, (m[1 : 1 + d, 1 : 1 + d] - n * np.outer(mean, mean)) / (n - ddof)


def _fixed_signs(v: np.ndarray) -> np.ndarray:
    """Eigenvectors with their largest entry positive, so a re-run gives the same axes."""
    pick = np.abs(v).argmax(0)
    return v * np.sign(v[pick, np.arange(v.shape[1])])


class Components:
    """Principal components from the moment matrix: mean, axes (d x m), variances."""

    def __init__(self, df: DataFrame, vec: str, m: int | None = None):
        mom = moment_matrix(df, vec)
        self.d = mom.shape[0] - 1
        self.n = int(mom[0, 0])
        self.mean, cov = covariance(mom, self.d)
        w, v = np.linalg.eigh(cov)
        order = np.argsort(w)[::-1][: m or self.d]
        self.variances = np.maximum(w[order], 0.0)
        self.axes = _fixed_signs(v[:, order])
        self.total = float(np.trace(cov))

    @property
    def ratios(self) -> np.ndarray:
        return self.variances / self.total

    def participation(self) -> float:
        """(sum of variances)^2 over the sum of squares."""
        return float(self.variances.sum() ** 2 / (self.variances**2).sum())

    def table(self, spark) -> DataFrame:
        rows = [(i, float(v), float(r)) for i, (v, r) in enumerate(zip(self.variances, self.ratios))]
        return spark.createDataFrame(rows, "component int, variance double, ratio double")

    def transform(self, df: DataFrame, vec: str, out: str) -> DataFrame:
        return project(df, vec, self.axes, out, center=self.mean)


def project(df: DataFrame, vec: str, weights: np.ndarray, out: str, center: np.ndarray | None = None, intercept: np.ndarray | None = None) -> DataFrame:
    """Array column of (x - center) W + intercept. W is d x m numbers, sent with the task."""
    w = np.asarray(weights, dtype=np.float64)
    w = w[:, None] if w.ndim == 1 else w
    shift = -(np.asarray(center) @ w) if center is not None else np.zeros(w.shape[1])
    shift = shift + (np.asarray(intercept) if intercept is not None else 0.0)

    @F.arrow_udf("array<double>")
    def score(x: pa.Array) -> pa.Array:
        return kernels.lists(kernels.matrix(x) @ w + shift if len(x) else np.zeros((0, w.shape[1])))

    return df.withColumn(out, score(F.col(vec)))


def whitening_matrix(df: DataFrame, vec: str, shrink: float = 1e-3) -> np.ndarray:
    """Inverse square root of the sample covariance plus a multiple of the identity."""
    mom = moment_matrix(df, vec)
    d = mom.shape[0] - 1
    _, cov = covariance(mom, d)
    w, v = np.linalg.eigh(cov + shrink * np.eye(d))
    return (v / np.sqrt(w)) @ v.T


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles in degrees between the column spaces of two matrices."""
    qa, _ = np.linalg.qr(a)
    qb, _ = np.linalg.qr(b)
    return np.degrees(np.arccos(np.clip(np.linalg.svd(qa.T @ qb, compute_uv=False), -1.0, 1.0)))


def random_directions(n: int, d: int, seed: int, length: float = 1.0) -> np.ndarray:
    """n directions of one length, as columns."""
    v = np.random.default_rng(seed).standard_normal((d, n))
    return v / np.linalg.norm(v, axis=0) * length


def axis_structure(df: DataFrame, vec: str, n_random: int = 200, seed: int = 0, min_rows: int = 50) -> DataFrame:
    """Is a set of difference vectors carried by one axis? Uncentred leading axis, its variance share, sign
    balance, mean length over median length, share along the axis, and the share of random directions."""
    spark = df.sparkSession
    mom = moment_matrix(df, vec)
    n, d = int(mom[0, 0]), mom.shape[0] - 1
    schema = "n long, leading_share double, sign_balance double, mean_over_median double, median_along double, share_above_half double, random_median double, random_lo double, random_hi double, expected_random double"
    if n < min_rows:
        return spark.createDataFrame([(n, *[None] * 9)], schema)
    g, mean = mom[1:, 1:], mom[0, 1:] / n
    w, v = np.linalg.eigh(g)
    c = _fixed_signs(v[:, -1:])[:, 0]
    total = float(np.trace(g))
    rnd = random_directions(n_random, d, seed)
    shares = np.einsum("ij,ij->j", rnd, g @ rnd) / total
    rows = project(df, vec, c, "_p").select(F.col("_p")[0].alias("p"), vectors.norm(vec).alias("len"))
    rows = rows.withColumn("along", F.abs("p") / (F.col("len") + 1e-12))
    q = ranking.quantiles_of(rows, ["len", "along"], [0.5], ["med"], )
    wide = q.agg(F.max(F.when(F.col("metric") == "len", F.col("med"))).alias("med_len"), F.max(F.when(F.col("metric") == "along", F.col("med"))).alias("med_along"))
    basic = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("p") > 0).cast("double")).alias("sign_balance"),
        F.avg((F.col("along") > 0.5).cast("double")).alias("share_above_half"),
    )
    one = basic.crossJoin(F.broadcast(wide))  # one row each
    lo, mid, hi = np.percentile(shares, [2.5, 50, 97.5])
    return one.select(
        "n", F.lit(float(w[-1] / total)).alias("leading_share"), "sign_balance",
        (F.lit(float(np.linalg.norm(mean))) / (F.col("med_len") + 1e-12)).alias("mean_over_median"), F.col("med_along").alias("median_along"),
        "share_above_half", F.lit(float(mid)).alias("random_median"), F.lit(float(lo)).alias("random_lo"), F.lit(float(hi)).alias("random_hi"),
        F.lit(1.0 / d).alias("expected_random"),
    )


def ring_scan(df: DataFrame, vec: str, angle_rad: str, k: int, n_components: int = 50) -> DataFrame:
    """Pairs of components ranked by min(R2 of cos k a, R2 of sin k a); all fits come from one moment matrix."""
    comp = Components(df, vec, n_components)
    t = comp.transform(df, vec, "_pc").select(F.col("_pc"), F.cos(k * F.col(angle_rad)).alias("_c"), F.sin(k * F.col(angle_rad)).alias("_s"))
    m = comp.axes.shape[1]
    mom = moment_matrix(t, "_pc", ["_c", "_s"])
    n = mom[0, 0]
    mu = mom[0] / n
    cov = mom / n - np.outer(mu, mu)
    rows = []
    for i in range(m):
        for j in range(i + 1, m):
            sel = [1 + i, 1 + j]
            a = cov[np.ix_(sel, sel)]
            r2 = []
            for t_i in (1 + m, 2 + m):
                b = cov[sel, t_i]
                r2.append(float(b @ np.linalg.solve(a, b) / cov[t_i, t_i]))
            rows.append((i, j, r2[0], r2[1], min(r2)))
    return df.sparkSession.createDataFrame(rows, "pc_a int, pc_b int, r2_cos double, r2_sin double, ring double")


def paired_difference(a: DataFrame, b: DataFrame, key: str, vec: str, out: str = "diff") -> DataFrame:
    """Row-wise a - b of two vector tables joined on their key."""
    r = b.select(key, F.col(vec).alias("_v"))
    return a.join(r, key).withColumn(out, vectors.subtract(vec, "_v")).drop("_v")


def norm_summary(df: DataFrame, diff: str, pool: str) -> DataFrame:
    """Count, mean, median, p10 and p90 of a vector's length per pool."""
    n = df.withColumn("_len", vectors.norm(diff))
    q = ranking.quantiles(n, "_len", [0.1, 0.5, 0.9], [pool], names=["p10", "median", "p90"])
    return n.groupBy(pool).agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("mean")).join(q, pool)
