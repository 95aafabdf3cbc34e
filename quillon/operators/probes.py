"""Ridge probes, circular readouts and concept directions from second moments.

A fit reads the rows twice whatever the number of penalties: one pass adds up the moment matrix, one pass adds up
leave-one-out errors for every penalty through the leverages. Only (d + targets)^2 numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import angles, hashing, vectors
from quillon.operators import inference, kernels, profiles, ranking, vector_stats as V
from quillon.runtime import cut_lineage

# Penalty grid of the probes, penalty of the concept directions, held-out share.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
ALPHA_DIRECTION = 100.0
TEST_SHARE = 0.2


def is_test(key: str, seed=0, share: float = TEST_SHARE) -> Column:
    return hashing.hash32(f"split{seed}", key) < F.lit(int(share * hashing.SPAN))


@dataclass
class Ridge:
    coef: np.ndarray  # d x targets
    intercept: np.ndarray
    alpha: list[float]
    n: int

    def score(self, df: DataFrame, vec: str, outs: Sequence[str]) -> DataFrame:
        """Attach one prediction column per target."""
        p = V.project(df, vec, self.coef, "_pred", intercept=self.intercept)
        return p.select("*", *[F.col("_pred")[i].alias(o) for i, o in enumerate(outs)]).drop("_pred")

    def direction(self, target: int = 0) -> np.ndarray:
        w = self.coef[:, target]
        return w / (np.linalg.norm(w) + 1e-12)


class Moments:
    """Centred moments of [vector, targets] and their eigen-decomposition."""

    def __init__(self, m: np.ndarray, n_targets: int, lead: int | None = None):
        d = m.shape[0] - 1 - n_targets
        t = slice(1 + d, None)
        keep = slice(1, 1 + (lead or d))
        self.n = float(m[0, 0])
        self.mx, self.my = m[0, keep] / self.n, m[0, t] / self.n
        self.xx = m[keep, keep] - self.n * np.outer(self.mx, self.mx)
        self.xy = m[keep, t] - self.n * np.outer(self.mx, self.my)
        self.yy = np.diag(m[t, t]) - self.n * self.my**2
        lam, self.q = np.linalg.eigh(self.xx)
        self.lam = np.maximum(lam, 0.0)
        self.qy = self.q.T @ self.xy

    def fit(self, alpha: Sequence[float]) -> Ridge:
        coef = np.column_stack([self.q @ (self.qy[:, j] / (self.lam + a)) for j, a in enumerate(alpha)])
        return Ridge(coef, self.my - self.mx @ coef, [float(a) for a in alpha], int(self.n))


def loo_errors(df: DataFrame, vec: str, targets: Sequence[str], mom: Moments, alphas: Sequence[float], lead: int | None = None) -> np.ndarray:
    """Sum of squared leave-one-out errors per (penalty, target) from one pass over the rows."""
    q, lam, mx, my, qy, n = mom.q, mom.lam, mom.mx, mom.my, mom.qy, mom.n
    k, t = len(alphas), len(targets)

    def partial(batches):
        acc = np.zeros(k * t)
        for b in batches:
            if b.num_rows == 0:
                continue
            z = (kernels.matrix(b.column(vec))[:, : (lead or None)] - mx) @ q
            y = np.column_stack([kernels.numbers(b, c) for c in targets])
            z2 = z * z
            for i, a in enumerate(alphas):
                shrink = 1.0 / (lam + a)
                h = 1.0 / n + z2 @ shrink
                e = (y - my - z @ (shrink[:, None] * qy)) / np.maximum(1.0 - h, 1e-12)[:, None]
                acc[i * t : (i + 1) * t] += (e * e).sum(0)
        yield pa.RecordBatch.from_arrays([kernels.lists(acc[None, :])], names=["e"])

    parts = df.select(vec, *targets).mapInArrow(partial, "e array<double>")
    total = parts.agg(vector_to_array(Summarizer.sum(array_to_vector("e"))).alias("e")).first()["e"]
    return np.array(total).reshape(k, t)


def _present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(cond)


def fit_ridge(df: DataFrame, vec: str, targets: Sequence[str], alphas: Sequence[float] = ALPHAS, lead: int | None = None) -> Ridge:
    """Ridge with an unpenalised intercept; with several penalties each target takes its best leave-one-out one.

    Rows missing any of the targets are left out, so call it once per set of labels that share their mask.
    """
    rows = _present(df, targets)
    mom = Moments(V.moment_matrix(rows, vec, targets), len(targets), lead)
    if len(alphas) == 1:
        return mom.fit([alphas[0]] * len(targets))
    err = loo_errors(rows, vec, targets, mom, alphas, lead)
    return mom.fit([alphas[i] for i in err.argmin(0)])


def r2(y: str, p: str, total: Callable[..., Column] = lambda c=None: F.sum(F.lit(1.0) if c is None else c)) -> Column:
    """1 - SSE / SST as one aggregate, or in terms of another kind of sum."""
    yy, pp = F.col(y), F.col(p)
    sst = total(yy * yy) - F.pow(total(yy), 2) / total()
    return 1 - total((yy - pp) * (yy - pp)) / sst


def _one(point: DataFrame, ci: DataFrame, metric: str, prefix: str) -> DataFrame:
    row = ci.where(F.col("metric") == metric).select(F.col("ci_lo").alias(f"{prefix}_lo"), F.col("ci_hi").alias(f"{prefix}_hi"))
    return point.crossJoin(F.broadcast(row))  # one row


def probe(df: DataFrame, key: str, vec: str, label: str, alphas: Sequence[float] = ALPHAS, seed=0, n_boot: int = inference.N_BOOT) -> DataFrame:
    """Held-out R2 of a ridge probe with its bootstrap interval over fixed predictions."""
    rows = _present(df.select(key, vec, F.col(label).cast("double").alias("y")), ["y"])
    test = is_test(key, seed)
    fit = fit_ridge(rows.where(~test), vec, ["y"], alphas)
    held = fit.score(rows.where(test), vec, ["p"]).select(key, "y", "p")
    point = held.agg(F.count(F.lit(1)).alias("n_test"), r2("y", "p").alias("r2"))
    reps = inference.bootstrap(held, key, {"r2": lambda total: r2("y", "p", total)}, n_boot, f"boot{seed}")
    out = _one(point, inference.intervals(reps, ["r2"]), "r2", "r2")
    return out.select("r2", "r2_lo", "r2_hi", "n_test", F.lit(fit.n).alias("n_train"), F.lit(fit.alpha[0]).alias("alpha"))


def probes(df: DataFrame, key: str, vec: str, labels: Sequence[str], **kw) -> DataFrame:
    """One probe per label, each over the rows that carry it."""
    out = None
    for name in labels:
        one = probe(df, key, vec, name, **kw).withColumn("label", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# ---- circular readouts --------------------------------------------------------------------------------------

def circular_targets(df: DataFrame, angle_rad: str, k: int) -> DataFrame:
    return df.where(F.col(angle_rad).isNotNull()).withColumns({"_c": F.cos(k * F.col(angle_rad)), "_s": F.sin(k * F.col(angle_rad))})


def fit_circular(df: DataFrame, vec: str, angle_rad: str, k: int, alphas: Sequence[float] = ALPHAS, lead: int | None = None) -> Ridge:
    return fit_ridge(circular_targets(df, angle_rad, k), vec, ["_c", "_s"], alphas, lead)


def circular_readout(fit: Ridge, df: DataFrame, vec: str, angle_rad: str, k: int) -> DataFrame:
    """Predicted cosine and sine, readout angle in degrees, circular error and loop radius per row."""
    return _with_readout(fit.score(circular_targets(df, angle_rad, k), vec, ["pc", "ps"]), angle_rad, k)


def _with_readout(p: DataFrame, angle_rad: str, k: int) -> DataFrame:
    return p.withColumns({
        "read_deg": F.degrees(F.atan2("ps", "pc")) / k, "radius": F.hypot("pc", "ps"),
        "err": angles.circular_error(F.atan2("ps", "pc"), k * F.col(angle_rad), k),
    })


def circular_summary(scored: DataFrame, k: int, by: Sequence[str] = (), min_rows: int = 1) -> DataFrame:
    """Median error, loop radius, share within 20 degrees, R2 of both coordinates and the chance floor."""
    by = list(by)
    basic = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("err") < 20).cast("double")).alias("within_20"), r2("_c", "pc").alias("r2_cos"),
        r2("_s", "ps").alias("r2_sin"), F.sqrt(F.avg(F.col("radius") * F.col("radius"))).alias("radius_rms"),
    ).where(F.col("n") >= min_rows)
    rows = scored.count()
    e = ranking.quantiles(scored, "err", [0.5], by, rows=rows, names=["med_err"])
    r = ranking.quantiles(scored, "radius", [0.5], by, rows=rows, names=["loop_radius"])
    return ranking.null_safe_join(ranking.null_safe_join(basic, e, by), r, by).withColumn("chance", angles.chance_floor(k))


def circular_probe(df: DataFrame, key: str, vec: str, angle_rad: str, k: int, alphas: Sequence[float] = ALPHAS, seed=0, n_boot: int = inference.N_BOOT, lead: int | None = None) -> DataFrame:
    """Circular probe with intervals on the median error and the share within 20 degrees."""
    rows = df.select(key, vec, angle_rad).where(F.col(angle_rad).isNotNull())
    test = is_test(key, seed)
    fit = fit_circular(rows.where(~test), vec, angle_rad, k, alphas, lead)
    v = F.slice(vec, 1, lead).alias(vec) if lead else F.col(vec)
    held = cut_lineage(circular_readout(fit, rows.where(test).select(key, v, angle_rad), vec, angle_rad, k).drop(vec))
    med = inference.bootstrap_quantile(held, key, "err", 0.5, n_boot, f"boot{seed}")
    share = inference.bootstrap(held, key, {"within": lambda total: total((F.col("err") < 20).cast("double")) / total()}, n_boot, f"boot{seed}")
    out = _one(circular_summary(held, k), inference.intervals(med, ["err"]), "err", "med_err")
    return _one(out, inference.intervals(share, ["within"]), "within", "within_20").withColumns({"n_train": F.lit(fit.n), "alpha_cos": F.lit(fit.alpha[0]), "alpha_sin": F.lit(fit.alpha[1])})


def linear_angle_probe(df: DataFrame, key: str, vec: str, angle_deg: str, period: float, seed=0) -> DataFrame:
    """Plain ridge on the raw angle, scored with the same wrapped error."""
    rows = df.select(key, vec, F.col(angle_deg).alias("y")).where(F.col("y").isNotNull())
    test = is_test(key, seed)
    fit = fit_ridge(rows.where(~test), vec, ["y"])
    held = fit.score(rows.where(test), vec, ["p"])
    half = period / 2
    held = held.withColumn("err", F.abs(F.pmod(F.col("p") - F.col("y") + half, F.lit(period)) - half))
    q = ranking.quantiles(held, "err", [0.5], names=["med_err"])
    return held.agg(F.count(F.lit(1)).alias("n"), r2("y", "p").alias("r2"), F.avg((F.col("err") < 20).cast("double")).alias("within_20")).crossJoin(F.broadcast(q))


def grouped_ridge(df: DataFrame, key: str, vec: str, targets: Sequence[str], by: str, alpha: float, salts: int = 8) -> DataFrame:
    """A ridge fit per group: (by, n_train, coef, intercept), coef holding the targets' coefficients one after the other.

    A group's rows meet in at most ``salts`` tasks, each of which adds up one moment matrix per group; the matrix of a group is put together and solved in
    one task, so nothing but the plan grows on the driver. Any type of group column works, and NULL is a group.
    """
    t = len(targets)
    rows = _present(df, targets).select(by, vec, *targets, F.pmod(F.xxhash64(key), F.lit(salts)).alias("_salt"))
    rows = rows.repartition(by, "_salt").sortWithinPartitions(by)
    moments = V.moment_rows(rows, vec, targets, [by])

    def solve(part: pa.Table) -> pa.Table:
        i = part.column("i").to_numpy()
        fit = Moments(kernels.matrix(part.column("row"))[np.argsort(i)], t).fit([alpha] * t)
        one = part.select([by]).slice(0, 1)
        for name, value in (("n_train", pa.array([fit.n], pa.int64())), ("coef", kernels.lists(fit.coef.T.reshape(1, -1))), ("intercept", kernels.lists(fit.intercept[None, :]))):
            one = one.append_column(name, value)
        return one

    schema = T.StructType([df.schema[by], T.StructField("n_train", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("coef", "intercept")]])
    return moments.groupBy(by).applyInArrow(solve, schema)


def score_grouped(df: DataFrame, fits: DataFrame, by: str, vec: str, outs: Sequence[str]) -> DataFrame:
    """Attach each row's predictions by the fit of its own group; rows of groups without a fit are left out. One scan, whatever the number of groups."""
    joined = ranking.null_safe_join(df, fits.select(by, "coef", "intercept"), [by])
    t, kept = len(outs), df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(o, T.DoubleType()) for o in outs]])

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, c = kernels.matrix(b.column(vec)), kernels.matrix(b.column("coef")).reshape(b.num_rows, t, -1)
                p = np.einsum("ij,itj->it", x, c) + kernels.matrix(b.column("intercept"))
                yield pa.RecordBatch.from_arrays([*[b.column(f) for f in kept], *[pa.array(p[:, i]) for i in range(t)]], names=[*kept, *outs])

    return joined.select(*kept, "coef", "intercept").mapInArrow(run, schema)


def per_stratum_circular(df: DataFrame, key: str, vec: str, angle_rad: str, k: int, stratum: str, alpha: float, seed=0, min_rows: int = 1) -> DataFrame:
    """Refit inside every stratum, of any type and NULL included, and evaluate on its held-out rows: one plan for any number of strata."""
    rows = circular_targets(df.select(key, vec, angle_rad, stratum), angle_rad, k).where(vectors.usable(vec))
    test = is_test(key, seed)
    fits = cut_lineage(grouped_ridge(rows.where(~test), key, vec, ["_c", "_s"], stratum, alpha))
    scored = cut_lineage(_with_readout(score_grouped(rows.where(test), fits, stratum, vec, ["pc", "ps"]), angle_rad, k).drop(vec))
    return circular_summary(scored, k, [stratum], min_rows)


def component_sweep(df: DataFrame, key: str, vec: str, angle_rad: str, k: int, sweep: Sequence[int], seed=0, alpha: float = 1.0) -> DataFrame:
    """Circular probe on the first m principal components for several m: leading blocks of one moment matrix."""
    comp = V.Components(df, vec, max(sweep))
    rows = circular_targets(comp.transform(df, vec, "_pc"), angle_rad, k).select(key, F.col("_pc").alias("pc_all"), angle_rad, "_c", "_s")
    test = is_test(key, seed)
    m = V.moment_matrix(rows.where(~test), "pc_all", ["_c", "_s"])
    out = None
    for size in sweep:
        fit = Moments(m, 2, lead=size).fit([alpha, alpha])
        pad = np.zeros((max(sweep) - size, 2))
        full = Ridge(np.vstack([fit.coef, pad]), fit.intercept, fit.alpha, fit.n)
        one = circular_summary(circular_readout(full, rows.where(test), "pc_all", angle_rad, k), k)
        one = one.withColumns({"n_components": F.lit(size), "cum_variance": F.lit(float(comp.ratios[:size].sum()))})
        out = one if out is None else out.unionByName(one)
    return out


# ---- directions and angles ----------------------------------------------------------------------------------

def direction(df: DataFrame, vec: str, label: str, alpha: float = ALPHA_DIRECTION) -> np.ndarray:
    return fit_ridge(df.select(vec, F.col(label).cast("double").alias("y")), vec, ["y"], [alpha]).direction()


def angle_between(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.degrees(np.arccos(np.clip(a @ b, -1.0, 1.0))))


def label_angle(df: DataFrame, a: str, b: str) -> DataFrame:
    """Angle whose cosine is the labels' correlation, over the rows that carry both."""
    both = _present(df, [a, b])
    return both.agg(F.degrees(F.acos(F.least(F.greatest(F.corr(a, b), F.lit(-1.0)), F.lit(1.0)))).alias("label_angle"))


def direction_replicates(df: DataFrame, key: str, vec: str, label: str, n_boot: int, seed, alpha: float = ALPHA_DIRECTION, budget: int = 256 << 20) -> DataFrame:
    """Refitted unit direction per bootstrap replicate: (rep, direction).

    Each partition adds the moment matrices of a chunk of replicates at once, as many as fit the byte budget; the
    matrices of one replicate (d + 2 rows) meet in one task that solves it.
    """
    rows = _present(df.select(key, vec, F.col(label).cast("double").alias("y")), ["y"])
    d = len(rows.select(vec).first()[0])
    chunk = max(1, min(n_boot, budget // (8 * (d + 2) ** 2)))
    schema = "rep int, i int, row array<double>"
    out = None
    for start in range(0, n_boot, chunk):
        reps = list(range(start, min(n_boot, start + chunk)))
        w = F.transform(F.array(*[F.lit(r) for r in reps]), lambda r: hashing.poisson1(hashing.hash32(seed, r, F.col(key)) / F.lit(hashing.SPAN)).cast("double"))

        def partial(batches, reps=reps):
            acc = None
            for b in batches:
                if b.num_rows == 0:
                    continue
                a = np.hstack([np.ones((b.num_rows, 1)), kernels.matrix(b.column(vec)), kernels.numbers(b, "y")[:, None]])
                wt = kernels.matrix(b.column("_w"))
                if acc is None:
                    acc = np.zeros((len(reps), a.shape[1], a.shape[1]))
                for j in range(len(reps)):
                    acc[j] += a.T @ (a * wt[:, j : j + 1])
            if acc is not None:
                for j, r in enumerate(reps):
                    m = acc.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, r, np.int32)), pa.array(np.arange(m, dtype=np.int32)), kernels.lists(acc[j])], names=["rep", "i", "row"]
                    )

        parts = rows.select(vec, "y", w.alias("_w")).mapInArrow(partial, schema)
        out = parts if out is None else out.unionByName(parts)
    total = out.groupBy("rep", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))

    def solve(t: pa.Table) -> pa.Table:
        o = np.argsort(t.column("i").to_numpy())
        m = kernels.matrix(t.column("row"))[o]
        unit = Moments(m, 1).fit([alpha]).direction()
        return pa.Table.from_arrays([t.column("rep").slice(0, 1), kernels.lists(unit[None, :])], names=["rep", "direction"])

    return total.groupBy("rep").applyInArrow(solve, "rep int, direction array<double>")


def concept_angle(df: DataFrame, key: str, vec: str, a: str, b: str, n_boot: int = inference.N_BOOT, seed=0) -> DataFrame:
    """Angle between two label directions, the label-correlation angle and their difference, with percentile and
    basic intervals from refits. Each direction uses the rows that carry its own label."""
    point = angle_between(direction(df, vec, a), direction(df, vec, b))
    ra = direction_replicates(df, key, vec, a, n_boot, f"{seed}a").withColumnRenamed("direction", "da")
    rb = direction_replicates(df, key, vec, b, n_boot, f"{seed}b").withColumnRenamed("direction", "db")
    clip = lambda c: F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))))
    both = _present(df.select(key, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")), ["a", "b"])
    x, y = F.col("a"), F.col("b")

    def correlation(total):
        n, sx, sy = total(), total(x), total(y)
        cov = total(x * y) - sx * sy / n
        return cov / F.sqrt((total(x * x) - F.pow(sx, 2) / n) * (total(y * y) - F.pow(sy, 2) / n))

    nulls = inference.bootstrap(both, key, {"null": lambda total: clip(correlation(total))}, n_boot, f"{seed}ab")
    reps = ra.join(rb, "rep").join(nulls, "rep").select("rep", clip(vectors.dot("da", "db")).alias("angle"), "null").withColumn("excess", F.col("angle") - F.col("null"))
    ci = inference.intervals(reps, ["angle", "null", "excess"])
    pts = label_angle(both, "a", "b").select(F.lit(point).alias("angle"), F.col("label_angle").alias("null"))
    pts = pts.withColumn("excess", F.col("angle") - F.col("null"))
    long = pts.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("point")) for m in ("angle", "null", "excess")])).alias("p")).select("p.*")
    lo, hi = inference.basic_interval(F.col("point"), F.col("ci_lo"), F.col("ci_hi"))
    return long.join(ci, "metric").select("metric", "point", "ci_lo", "ci_hi", lo.alias("basic_lo"), hi.alias("basic_hi"))


def angle_battery(df: DataFrame, vec: str, labels: Sequence[str], alpha: float = ALPHA_DIRECTION) -> DataFrame:
    """All pairs of label directions (a short list of labels) with the label-correlation angle."""
    w = {name: direction(df, vec, name, alpha) for name in labels}
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i + 1 :]]
    one = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))).alias(f"{a}|{b}") for a, b in pairs]).first()
    rows = [(a, b, angle_between(w[a], w[b]), float(np.degrees(np.arccos(np.clip(one[f"{a}|{b}"], -1, 1))))) for a, b in pairs]
    return df.sparkSession.createDataFrame([(*r, r[2] - r[3]) for r in rows], "a string, b string, angle double, label_angle double, excess double")


def random_pair_angles(df: DataFrame, key: str, vec: str, seed=0) -> DataFrame:
    """(dims, p5, median, p95): percentiles in degrees of the angle between the vectors of random pairs of rows.

    Rows are paired in hash order, the first with the second and so on, so every usable row is in one pair at most.
    """
    rows = df.where(vectors.usable(vec)).select(key, vec)
    order = cut_lineage(ranking.hash_order(rows, key, seed, out="_r").select(vec, F.col("_r").alias("_r")))
    at = F.expr("(_r - 1) div 2").alias("_pair")
    a, b = (order.where(F.col("_r") % 2 == odd).select(at, F.col(vec).alias(name)) for odd, name in ((1, "_a"), (0, "_b")))
    cosine = F.least(F.greatest(vectors.cosine("_a", "_b"), F.lit(-1.0)), F.lit(1.0))
    angle = cut_lineage(a.join(b, "_pair").where((vectors.norm("_a") > 0) & (vectors.norm("_b") > 0)).select(F.size("_a").alias("dims"), F.degrees(F.acos(cosine)).alias("angle")))
    q = ranking.quantiles(angle, "angle", [0.05, 0.5, 0.95], names=["p5", "median", "p95"])
    return angle.agg(F.max("dims").alias("dims")).crossJoin(F.broadcast(q))  # one row


def steering_response(df: DataFrame, vec: str, steer: str, labels: Sequence[str], amount: float, alpha: float = ALPHA_DIRECTION) -> DataFrame:
    """Linear response of every readout to a step along one readout's direction, restated from the weights."""
    fits = {n: fit_ridge(df.select(vec, F.col(n).cast("double").alias("y")), vec, ["y"], [alpha]).coef[:, 0] for n in {steer, *labels}}
    w = fits[steer]
    size = float(np.linalg.norm(w))
    sd = df.agg(*[F.stddev_pop(F.col(n).cast("double")).alias(n) for n in labels]).first()
    rows = [(n, float(amount / size * (w / size) @ fits[n]), float(amount / size * (w / size) @ fits[n] / (sd[n] + 1e-9))) for n in labels]
    return df.sparkSession.createDataFrame(rows, "label string, delta double, delta_per_sigma double")


# ---- covariates, ranks, polynomial fits ---------------------------------------------------------------------

def residualise(df: DataFrame, label: str, covariates: Sequence[str], alpha: float, out: str) -> DataFrame:
    """Label minus its ridge prediction from standardised covariates; NULL where any input is missing."""
    rows = _present(df, [label, *covariates])
    m = V.moment_matrix(rows, None, [*covariates, label])
    n, k = m[0, 0], len(covariates)
    mu = m[0] / n
    sd = np.sqrt(np.maximum(np.diag(m)[1 : 1 + k] / n - mu[1 : 1 + k] ** 2, 0.0)) + 1e-9
    cov = m - n * np.outer(mu, mu)
    a = cov[1 : 1 + k, 1 : 1 + k] / np.outer(sd, sd)
    b = cov[1 : 1 + k, 1 + k] / sd
    w = np.linalg.solve(a + alpha * np.eye(k), b) / sd
    pred = F.lit(float(mu[1 + k] - w @ mu[1 : 1 + k]))
    for c, x in zip(covariates, w):
        pred = pred + F.lit(float(x)) * F.col(c).cast("double")
    return df.withColumn(out, F.col(label) - pred)


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), min_rows: int = 2) -> DataFrame:
    """Rank correlation (average ties) per group with at least ``min_rows`` complete rows."""
    by = list(by)
    rows = _present(df.select(*by, x, y), [x, y])
    n = rows.count()
    r = ranking.with_average_rank(ranking.with_average_rank(rows, x, "_rx", by, n), y, "_ry", by, n)
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho")).where(F.col("n") >= min_rows)


def partial_spearman(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Spearman of the residuals of rank(x) and rank(y) on rank(z)."""
    r = _present(df.select(x, y, z), [x, y, z])
    for c in (x, y, z):
        r = ranking.with_average_rank(r, c, f"_r{c}")
    fit = r.agg(*[f(F.col(f"_r{c}"), F.col(f"_r{z}")).alias(f"{n}_{c}") for c in (x, y) for n, f in (("s", F.regr_slope), ("i", F.regr_intercept))])
    r = r.crossJoin(F.broadcast(fit))  # one row
    res = r.select(*[F.round(F.col(f"_r{c}") - F.col(f"s_{c}") * F.col(f"_r{z}") - F.col(f"i_{c}"), 7).alias(c) for c in (x, y)])
    return spearman(res, x, y)


def polynomial_ridge(df: DataFrame, key: str, features: Sequence[str], label: str, alphas: Sequence[float], seed=0, apply: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Degree-2 polynomial ridge: (held-out report, whole table with prediction and in-range flag); the latter only with ``apply``.

    The report is from an 80/20 split; the applied model is refitted on every labelled row. A row is in range
    when each feature lies inside the labelled rows' 1-99 percentiles.
    """
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler

    ok = _present(df, features)
    vec = PolynomialExpansion(degree=2, inputCol="_f", outputCol="_pv").transform(VectorAssembler(inputCols=list(features), outputCol="_f").transform(ok))
    rows = vec.withColumn("_poly", vector_to_array("_pv")).drop("_f", "_pv")
    train = _present(rows, [label])
    test = is_test(key, seed)

    def fitted(part):
        z = V.zscore(part, "_poly")
        stats = V.dim_stats(part, "_poly")
        return fit_ridge(z, "_poly", [label], alphas), stats

    fit, stats = fitted(train.where(~test))
    held = fit.score(V.zscore(train.where(test), "_poly", stats), "_poly", ["pred"])
    rho = spearman(held, label, "pred").select("rho")
    report = held.agg(
        F.count(F.lit(1)).alias("n_test"), r2(label, "pred").alias("r2"), F.sqrt(F.avg(F.pow(F.col(label) - F.col("pred"), 2))).alias("rmse")
    ).crossJoin(F.broadcast(rho)).withColumn("alpha", F.lit(fit.alpha[0]))
    if not apply:
        return report, None
    fit, stats = fitted(train)
    bounds = {r["metric"]: (r["lo"], r["hi"]) for r in ranking.quantiles_of(train, features, [0.01, 0.99], ["lo", "hi"]).collect()}  # one row per feature
    inside = F.lit(True)
    for f in features:
        inside = inside & F.col(f).between(*bounds[f])
    applied = fit.score(V.zscore(rows, "_poly", stats), "_poly", ["pred"]).select(key, *features, "pred", inside.alias("in_range"))
    return report, applied


# ---- contrasts and interventions ----------------------------------------------------------------------------

def contrast_null(df: DataFrame, key: str, vec: str, parent: np.ndarray, group: Column, n_child: int, n_rep: int = 200, seed=0) -> DataFrame:
    """|cosine| of the parent axis with the contrast of a random subset of ``n_child`` rows, per replicate."""
    g = df.where(group).select(key, vec)
    reps = g.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1)))).withColumn("_k", F.concat_ws(":", "rep", key))
    p = F.array(*[F.lit(float(x)) for x in parent])
    ranked = ranking.hash_order(reps, "_k", seed, ["rep"]).withColumn("_in", F.col("rn") <= n_child)
    means = ranked.groupBy("rep", "_in").agg(vector_to_array(Summarizer.mean(array_to_vector(vectors.as_double(vec)))).alias("m"))
    one = means.groupBy("rep").agg(F.max(F.when(F.col("_in"), F.col("m"))).alias("a"), F.max(F.when(~F.col("_in"), F.col("m"))).alias("b"))
    return one.select("rep", F.abs(vectors.cosine(vectors.subtract("a", "b"), p)).alias("cosine"))


def readout_shift(fit: Ridge, base: DataFrame, moved: DataFrame, key: str, vec: str, angle_rad: str, k: int = 2) -> DataFrame:
    """Readout before and after a transform per row: (key, angle, before, after, wrapped shift) in degrees."""
    before = circular_readout(fit, base, vec, angle_rad, k).select(key, angle_rad, F.col("read_deg").alias("before"))
    after = fit.score(moved.select(key, vec), vec, ["pc", "ps"]).select(key, (F.degrees(F.atan2("ps", "pc")) / k).alias("after"))
    return before.join(after, key).withColumn("shift", angles.axial_wrap(F.col("after") - F.col("before")))


def axial_mean(value_deg) -> tuple[Column, Column]:
    """Circular mean in degrees and resultant length of axial angles, as aggregates."""
    x = 2 * F.radians(value_deg)
    c, s = F.avg(F.cos(x)), F.avg(F.sin(x))
    return F.degrees(F.atan2(s, c)) / 2, F.hypot(c, s)


def intervention_summary(shifts: DataFrame, expected_deg: float) -> DataFrame:
    """Recovered shift against the expected one: medians, circular mean, resultant length, fixed-point and
    antinode displacement."""
    d = shifts.withColumn("err", F.abs(angles.axial_wrap(F.col("shift") - F.lit(expected_deg))))
    mean, length = axial_mean(F.col("shift"))
    q = ranking.quantiles_of(d, ["shift", "err"], [0.5], ["m"])
    wide = q.agg(F.max(F.when(F.col("metric") == "shift", F.col("m"))).alias("median_shift"), F.max(F.when(F.col("metric") == "err", F.col("m"))).alias("median_error"))
    basic = d.agg(F.count(F.lit(1)).alias("n"), mean.alias("circular_mean"), length.alias("resultant"))
    return basic.crossJoin(F.broadcast(wide)).withColumn("expected", F.lit(float(expected_deg)))  # one row each


def shift_slope(summaries: DataFrame) -> DataFrame:
    """Slope of the recovered on the expected shift over several interventions; +-90 is left out (wrap boundary)."""
    return summaries.where(F.abs("expected") != 90).agg(F.regr_slope("median_shift", "expected").alias("slope"), F.regr_intercept("median_shift", "expected").alias("intercept"), F.count(F.lit(1)).alias("n_shifts"))


def invariance(base: DataFrame, moved: DataFrame, key: str, vec: str, label: str, seed=0, n_random: int = 20) -> DataFrame:
    """Does another readout stay put under a transform: R2 before and after, median change over label, prediction
    and residual spread, and the same relative change for random directions of the readout's length."""
    rows = base.select(key, vec, F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull())
    test = is_test(key, seed)
    fit = fit_ridge(rows.where(~test), vec, ["y"])
    dirs = V.random_directions(n_random, fit.coef.shape[0], 0, float(np.linalg.norm(fit.coef)))
    w = np.hstack([fit.coef, dirs])
    b0 = np.r_[fit.intercept, np.zeros(n_random)]
    p = V.project(rows.where(test), vec, w, "p0", intercept=b0).select(key, "y", "p0")
    t = V.project(moved.select(key, vec).where(test), vec, w, "p1", intercept=b0).select(key, "p1")
    j = p.join(t, key).select(key, "y", F.col("p0")[0].alias("before"), F.col("p1")[0].alias("after"), "p0", "p1").withColumn("change", F.abs(F.col("after") - F.col("before")))
    j = cut_lineage(j)  # joined once, read by every statistic
    q = ranking.quantiles(j, "change", [0.5], names=["median_change"])
    basic = j.agg(
        F.count(F.lit(1)).alias("n"), r2("y", "before").alias("r2_before"), r2("y", "after").alias("r2_after"), F.corr("before", "after").alias("correlation"),
        F.stddev_pop("y").alias("_ls"), F.stddev_pop("before").alias("_ps"), F.stddev_pop(F.col("y") - F.col("before")).alias("_rs"),
    ).crossJoin(F.broadcast(q))
    rnd = j.select(F.posexplode(F.arrays_zip("p0", "p1")).alias("i", "z")).where(F.col("i") > 0).select("i", F.col("z.p0").alias("a"), F.abs(F.col("z.p1") - F.col("z.p0")).alias("c"))
    rel = rnd.groupBy("i").agg(F.stddev_pop("a").alias("sd")).join(ranking.quantiles(rnd, "c", [0.5], ["i"], names=["m"]), "i").agg(F.percentile(F.col("m") / F.col("sd"), 0.5).alias("random_over_spread"))
    return basic.crossJoin(F.broadcast(rel)).select(
        "n", "r2_before", "r2_after", (F.col("r2_after") - F.col("r2_before")).alias("delta_r2"), "correlation", "median_change",
        (F.col("median_change") / F.col("_ls")).alias("over_label_sd"), (F.col("median_change") / F.col("_ps")).alias("over_prediction_sd"),
        (F.col("median_change") / F.col("_rs")).alias("over_residual_sd"), "random_over_spread",
    )


def error_by_covariate(scored: DataFrame, err: str, covariate: str, control: str | None = None, n_bins: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rank correlation of the error with a covariate (partial when a control is given) and quantile-bin medians."""
    rho = spearman(scored, covariate, err) if control is None else partial_spearman(scored, covariate, err, control)
    binned = profiles.quantile_bin(scored, covariate, n_bins, "_q")
    return rho, profiles.binned_profile(binned, F.col("_q"), err, {"median_err": 0.5})


def by_family(results: DataFrame, label: str, family: Mapping[str, str], operation: str, value: str) -> DataFrame:
    """Mean change per label and operation family."""
    fam = F.create_map(*[F.lit(x) for kv in family.items() for x in kv])
    return results.withColumn("family", fam[F.col(operation)]).groupBy(label, "family").agg(F.avg(value).alias(f"mean_{value}"), F.count(F.lit(1)).alias("n"))
