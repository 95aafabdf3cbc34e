"""Two-sample comparison of populations: occupancy, balancing weights, classifier AUC, conformal lists, planted
shifts, moment balance and kernel discrepancy."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import hashing, vectors
from quillon.operators import inference, joins, kernels, knn, probes, ranking, vector_stats as V
from quillon.runtime import cut_lineage, spread


def occupancy_ratio(df: DataFrame, key: str, sample: str, region: Column, weight: Column, n_boot: int = inference.N_BOOT, seed=0) -> DataFrame:
    """Weighted share of sample 'a' in a region over the share of sample 'b', with its bootstrap interval."""
    x = df.select(key, F.col(sample).alias("s"), region.cast("double").alias("in"), weight.cast("double").alias("wt"))

    def ratio(total):
        share = lambda v: total(F.when(F.col("s") == v, F.col("wt") * F.col("in"))) / total(F.when(F.col("s") == v, F.col("wt")))
        return share("a") / share("b")

    point = x.agg(ratio(F.sum).alias("ratio"), (F.pow(F.sum(F.when(F.col("s") == "a", F.col("wt"))), 2) / F.sum(F.when(F.col("s") == "a", F.col("wt") * F.col("wt")))).alias("ess"))
    ci = inference.intervals(inference.bootstrap(x, key, {"ratio": ratio}, n_boot, seed), ["ratio"]).select("ci_lo", "ci_hi")
    return point.crossJoin(F.broadcast(ci))  # one row each


def balancing_weights(df: DataFrame, sample: str, strata: Sequence[str]) -> DataFrame:
    """Weight n_b / n_a per stratum on the rows of sample 'a', one on sample 'b'; a stratum without 'b' gets zero."""
    n = df.groupBy(*strata).agg(F.count_if(F.col(sample) == "a").alias("_na"), F.count_if(F.col(sample) == "b").alias("_nb"))
    return df.join(n, list(strata)).withColumn("weight", F.when(F.col(sample) == "a", F.col("_nb") / F.col("_na")).otherwise(F.lit(1.0))).drop("_na", "_nb")


def auc(df: DataFrame, score: str, positive: Column, weight: Column | None = None) -> DataFrame:
    """Area under the curve from ranks with ties shared: P(score of a positive > score of a negative).

    Weighted form: each distinct score knows the negative weight strictly below it and at it.
    """
    w = F.lit(1.0) if weight is None else weight
    x = df.select(F.col(score).alias("s"), positive.alias("p"), w.alias("w"))
    g = x.groupBy("s").agg(F.sum(F.when(F.col("p"), F.col("w")).otherwise(0.0)).alias("wp"), F.sum(F.when(~F.col("p"), F.col("w")).otherwise(0.0)).alias("wn"))
    r = ranking.value_ranks(g, "s").select("s", "before")
    chunk = F.floor(F.col("before") / 100_000)
    j = g.join(r, "s").withColumn("_c", chunk)
    from pyspark.sql import Window

    per = j.groupBy("_c").agg(F.sum("wn").alias("_t"))
    order = Window.orderBy("_c")  # one row per 100k distinct scores
    carry = per.select("_c", (F.sum("_t").over(order) - F.col("_t")).alias("_off"))
    inside = Window.partitionBy("_c").orderBy("s")
    k = j.join(carry, "_c").withColumn("_below", F.sum("wn").over(inside) - F.col("wn") + F.col("_off"))
    return k.agg((F.sum(F.col("wp") * (F.col("_below") + F.col("wn") / 2)) / (F.sum("wp") * F.sum("wn"))).alias("auc"))


def two_sample_auc(df: DataFrame, key: str, vec: str, sample: str, weight: str | None = None, seed=0, reg: float = 1e-3) -> DataFrame:
    """Held-out AUC of a linear classifier telling sample 'a' from 'b', optionally importance-weighted."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    cols = [F.col(key), array_to_vector(vectors.as_double(vec)).alias("features"), (F.col(sample) == "a").cast("double").alias("label")]
    cols.append((F.col(weight) if weight else F.lit(1.0)).alias("w"))
    rows = df.select(*cols)
    test = probes.is_test(key, seed, 0.5)
    model = LogisticRegression(weightCol="w", regParam=reg, maxIter=100).fit(rows.where(~test))
    held = model.transform(rows.where(test)).select("label", "w", vector_to_array("rawPrediction")[1].alias("score"))
    n = held.agg(F.count(F.lit(1)).alias("n"))
    return auc(held, "score", F.col("label") == 1, F.col("w")).crossJoin(F.broadcast(n))  # one row each


def conformal_pvalues(test: DataFrame, calibration: DataFrame, key: str, score: str) -> DataFrame:
    """(1 + calibration scores at or above) / (n + 1) per test row."""
    n = calibration.where(F.col(score).isNotNull()).count()
    at = F.col(score).cast("double")
    ranks = ranking.value_ranks(calibration, score).select(at.alias("at"), at.alias("cal_at"), F.col("before").alias("cal_before"), F.col("n").alias("cal_n"))
    j = joins.asof_join(test.select(key, at.alias("at")), ranks, "at", ["cal_at", "cal_before", "cal_n"])
    below = F.when(F.col("cal_at").isNull(), 0).when(F.col("cal_at") == F.col("at"), F.col("cal_before")).otherwise(F.col("cal_before") + F.col("cal_n"))
    return j.select(key, F.col("at").alias(score), ((1 + F.lit(n) - below) / F.lit(n + 1)).alias("p"))


def plant_shift(df: DataFrame, key: str, vec: str, direction: np.ndarray, amount: float, share: float = 1.0, seed=0) -> DataFrame:
    """Move a hash-chosen share of the rows by ``amount`` along a direction; column ``planted`` marks them."""
    d = F.array(*[F.lit(float(x) * amount) for x in direction])
    hit = hashing.uniform(seed, key) < share
    return df.withColumn("planted", hit).withColumn(vec, F.when(F.col("planted"), F.zip_with(vectors.as_double(vec), d, lambda x, y: x + y)).otherwise(vectors.as_double(vec)))


def plant_deletion(df: DataFrame, key: str, region: Column, share: float, seed=0) -> DataFrame:
    """Remove a hash-chosen share of the rows of a region."""
    return df.where(~(F.coalesce(region, F.lit(False)) & (hashing.uniform(seed, key) < share)))


def plant_scale(df: DataFrame, vec: str, direction: np.ndarray, variance_factor: float) -> DataFrame:
    """Inflate the variance along a unit direction."""
    u = np.asarray(direction) / np.linalg.norm(direction)
    p = V.project(df, vec, u, "_p")
    lit = F.array(*[F.lit(float(x)) for x in u])
    grow = (math.sqrt(variance_factor) - 1) * F.col("_p")[0]
    return p.withColumn(vec, F.zip_with(vectors.as_double(vec), lit, lambda x, y: x + grow * y)).drop("_p")


def standardised_difference(df: DataFrame, sample: str, value: str, by: Sequence[str], limit: float = 0.05) -> DataFrame:
    """Mean difference over the pooled spread per bin, and whether it is under the limit."""
    a, b = F.when(F.col(sample) == "a", F.col(value)), F.when(F.col(sample) == "b", F.col(value))
    g = df.groupBy(*by).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"))
    smd = (F.col("_ma") - F.col("_mb")) / F.sqrt((F.col("_va") + F.col("_vb")) / 2)
    return g.select(*by, "n_a", "n_b", smd.alias("smd")).withColumn("balanced", F.coalesce(F.abs("smd") < limit, F.lit(False)))


def mmd(a: DataFrame, b: DataFrame, id_col: str, vec: str, bandwidth: float, block_bytes: int = knn.BLOCK_BYTES) -> DataFrame:
    """Unbiased squared maximum mean discrepancy with a Gaussian kernel, summed tile by tile.

    Every pair of row blocks is one tile; a tile emits one number, so nothing of pair size is stored or moved.
    """
    prep = lambda df, s: df.select(F.col(id_col).cast("long").alias("_id"), vectors.as_double(vec).alias("_v"), F.lit(s).alias("_s"))
    both = prep(a, 0).unionByName(prep(b, 1))
    info = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_s") == 0).alias("na"), F.max(F.size("_v")).alias("d")).first()
    n, na, nb = info["n"], info["na"], info["n"] - info["na"]
    workers = a.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n * 8 * info["d"] / block_bytes), min(workers, math.ceil(n / 256)))
    blk = F.pmod(F.xxhash64("_id", "_s"), F.lit(blocks)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = both.withColumn("i", blk).withColumn("j", spread)
    t = both.select(*[F.col(c).alias(c) for c in both.columns]).withColumn("j", blk).withColumn("i", spread)
    gamma = 1.0 / (2.0 * bandwidth * bandwidth)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = kernels.matrix(left.column("_v")), kernels.matrix(right.column("_v"))
        ids, sx = left.column("_id").to_numpy(), left.column("_s").to_numpy()
        idt, sy = right.column("_id").to_numpy(), right.column("_s").to_numpy()
        sums = np.zeros(3)
        yn = (y * y).sum(1)
        step = max(1, knn.PAIR_BUDGET // max(1, len(y)))
        for s in range(0, len(x), step):
            p = x[s : s + step]
            k = np.exp(-gamma * np.maximum((p * p).sum(1)[:, None] + yn - 2 * p @ y.T, 0.0))
            same = (ids[s : s + step, None] == idt) & (sx[s : s + step, None] == sy)
            k[same] = 0.0
            ax, ay = sx[s : s + step] == 0, sy == 0
            sums += [k[np.ix_(ax, ay)].sum(), k[np.ix_(~ax, ~ay)].sum(), k[np.ix_(ax, ~ay)].sum()]
        return pa.table({"aa": [sums[0]], "bb": [sums[1]], "ab": [sums[2]]})

    parts = min(blocks * blocks, 20_000)
    tiles = q.repartition(parts, "i", "j").groupBy("i", "j").cogroup(t.repartition(parts, "i", "j").groupBy("i", "j"))
    s = tiles.applyInArrow(run, "aa double, bb double, ab double")
    return s.agg((F.sum("aa") / (na * (na - 1)) + F.sum("bb") / (nb * (nb - 1)) - 2 * F.sum("ab") / (na * nb)).alias("mmd2"))


def nuisance_control(df: DataFrame, key: str, vec: str, label: str, covariates: Sequence[str], n_random: int = 2, seed=0, **kw) -> DataFrame:
    """Probe of a label, of its residual on covariates, and of its residual on as many random covariates."""
    rnd = {f"_rnd{i}_{j}": hashing.uniform(f"{seed}r{i}{j}", key) for i in range(n_random) for j in range(len(covariates))}
    d = df.withColumns(rnd)
    d = probes.residualise(d, label, list(covariates), 10.0, "residual")
    names = [label, "residual"]
    for i in range(n_random):
        d = probes.residualise(d, label, [f"_rnd{i}_{j}" for j in range(len(covariates))], 10.0, f"random_{i}")
        names.append(f"random_{i}")
    return probes.probes(d, key, vec, names, **kw)


def decodability_table(df: DataFrame, ablated: DataFrame, key: str, vec: str, labels: Sequence[str], seed=0, **kw) -> DataFrame:
    """Per label: held-out R2 with interval, the shuffled-label floor, and R2 on the ablated vectors."""
    shuffled = df
    for name in labels:
        shuffled = inference.shuffle_within(shuffled, key, name, f"{seed}{name}", f"_sh_{name}")
    shuffled = cut_lineage(shuffled)
    a = probes.probes(df, key, vec, labels, **kw)
    f = probes.probes(shuffled, key, vec, [f"_sh_{n}" for n in labels], **kw).select(F.expr("substring(label, 5)").alias("label"), F.col("r2").alias("floor"))
    b = probes.probes(ablated, key, vec, labels, **kw).select("label", F.col("r2").alias("r2_ablated"))
    return a.join(f, "label").join(b, "label")


def angle_null(df: DataFrame, vec: str, labels: Sequence[str], n_draws: int = 200, seed: int = 0) -> DataFrame:
    """Excess angle of every label pair against a linear-Gaussian null: labels with exactly the observed
    correlation and noise level are drawn along random whitened directions, and pushed through the same ridge fit.

    The null works on d x d moments only; q-values control the false discovery rate over the pairs.
    """
    rows = df.select(vec, *[F.col(n).cast("double").alias(n) for n in labels]).dropna(subset=list(labels))
    m = V.moment_matrix(rows, vec, list(labels))
    t = len(labels)
    n, d = m[0, 0], m.shape[0] - 1 - t
    mom = probes.Moments(m, t)
    fit = mom.fit([probes.ALPHA_DIRECTION] * t)
    unit = fit.coef / (np.linalg.norm(fit.coef, axis=0) + 1e-12)
    share = np.clip([(2 * fit.coef[:, j] @ mom.xy[:, j] - fit.coef[:, j] @ mom.xx @ fit.coef[:, j]) / mom.yy[j] for j in range(t)], 1e-3, 0.999)
    mu = m[0] / n
    cov = m / n - np.outer(mu, mu)
    y = cov[1 + d :, 1 + d :]
    corr = y / np.sqrt(np.outer(np.diag(y), np.diag(y)))
    deg = lambda c: float(np.degrees(np.arccos(np.clip(c, -1, 1))))
    rhos = np.clip(corr, -1, 1)
    pairs = [(i * t + j, labels[i], labels[j], deg(unit[:, i] @ unit[:, j]) - deg(rhos[i, j]), float(rhos[i, j]), float(share[i]), float(share[j])) for i in range(t) for j in range(i + 1, t)]
    pairs = df.sparkSession.createDataFrame(pairs, "pair int, a string, b string, excess double, rho double, share_a double, share_b double")
    null = cut_lineage(_null_excess(pairs, mom.lam, float(n), n_draws, seed))
    st = null.groupBy(F.col("pair").alias("_p")).agg(F.avg("null").alias("null_mean"), F.stddev_pop("null").alias("null_std"))
    j = null.join(st, F.col("pair") == F.col("_p")).drop("_p").join(pairs.select(F.col("pair").alias("_p"), "a", "b", "excess"), F.col("pair") == F.col("_p"))
    beyond = F.abs(F.col("null") - F.col("null_mean")) >= F.abs(F.col("excess") - F.col("null_mean"))
    out = j.groupBy("a", "b", "excess", "null_mean", "null_std").agg(((1 + F.count_if(beyond)) / F.lit(n_draws + 1)).alias("p"))
    out = cut_lineage(out)
    return out.join(inference.bh_qvalues(out, "p"), "p").select("a", "b", "excess", "null_mean", "null_std", "p", "q")


def _null_excess(pairs: DataFrame, lam: np.ndarray, n: float, n_draws: int, seed: int) -> DataFrame:
    """(pair, draw, null): excess angle of every draw, each with normals seeded by (seed, pair, draw), solved in tasks.

    Angles do not change in the eigenbasis of the moments, where the fit divides by the eigenvalues: tasks need these d numbers and no matrix.
    """
    rows = pairs.select("pair", "rho", "share_a", "share_b", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))

    def solve(batches):
        for b in batches:
            pair, draw, rho, sa, sb = (b.column(c).to_numpy() for c in ("pair", "draw", "rho", "share_a", "share_b"))
            normals = np.array([np.random.default_rng([seed, p, i]).standard_normal((4, len(lam))) for p, i in zip(pair, draw)]).reshape(-1, 4, len(lam))
            yield pa.RecordBatch.from_arrays([b.column("pair"), b.column("draw"), pa.array(null_angles(normals, lam, n, rho, sa, sb))], names=["pair", "draw", "null"])

    return spread(rows).mapInArrow(solve, "pair int, draw int, null double")


def null_angles(normals: np.ndarray, lam: np.ndarray, n: float, rho: np.ndarray, share_a: np.ndarray, share_b: np.ndarray) -> np.ndarray:
    """Angle between the refitted directions of two labels of correlation rho, less the correlation's own angle. ``normals``: draws x (two directions, two noises) x d."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    first = unit(normals[:, 0])
    second = unit(normals[:, 1] - np.einsum("ij,ij->i", normals[:, 1], first)[:, None] * first)
    second = rho[:, None] * first + np.sqrt(1 - rho * rho)[:, None] * second
    w = []
    for c, z, s in ((first, normals[:, 2], share_a), (second, normals[:, 3], share_b)):
        # X'y of a label sqrt(s) x.c + noise: mean n root c, sampling noise of size sqrt(n (1 - s)).
        xy = np.sqrt(lam / n) * (n * np.sqrt(s)[:, None] * c + np.sqrt(n * (1 - s))[:, None] * z)
        w.append(unit(xy / (lam + probes.ALPHA_DIRECTION)))
    return np.degrees(np.arccos(np.clip(np.einsum("ij,ij->i", *w), -1, 1)) - np.arccos(np.clip(rho, -1, 1)))


def relation_by_population(df: DataFrame, x: str, y: str, population: str, min_rows: int = 30) -> DataFrame:
    """Slope, intercept and R2 of a relation inside every population."""
    return df.groupBy(population).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    ).where(F.col("n") >= min_rows)


def relation_residual(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """Residual of y on a straight line in x over the whole table."""
    fit = df.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return df.crossJoin(F.broadcast(fit)).withColumn(out, F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")  # one row
