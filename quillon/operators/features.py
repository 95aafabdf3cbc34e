"""Scoring of sparse dictionary features over many rows with a given dictionary.

A dictionary is a parameter of the analysis (a few thousand atoms); it travels with the tasks after a size check.
Activations stay sparse rows (id, feature, value); statistics over the absent zeros are filled in by arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon import runtime
from quillon.functions import vectors
from quillon.functions.special import t_pvalue
from quillon.operators import graph, inference, kernels, knn, ranking, vector_stats as V

DICT_BYTES = 512 << 20
ACTIVE_STD = 1e-6


def dictionary_matrix(dictionary: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, atoms as rows) after checking that the dictionary fits the byte bound."""
    size = dictionary.agg(F.count(F.lit(1)).alias("m"), F.max(F.size(vec)).alias("d")).first()
    if size["m"] * (size["d"] or 1) * 8 > DICT_BYTES:
        raise ValueError(f"a dictionary of {size['m']} x {size['d']} is over the {DICT_BYTES} byte bound")
    rows = dictionary.select("feature", vec).orderBy("feature").collect()
    return np.array([r["feature"] for r in rows], dtype=np.int32), np.array([r[vec] for r in rows], dtype=np.float64)


def sparse_encode(df: DataFrame, id_col: str, vec: str, dictionary: DataFrame, encoder: str = "encoder", k: int = 32, bias: np.ndarray | None = None, center: np.ndarray | None = None) -> DataFrame:
    """relu((x - center) W + bias), the k largest per row (ties by feature), positive ones as (id, feature, value)."""
    feats, w = dictionary_matrix(dictionary, encoder)
    shift = (bias if bias is not None else 0.0) - (w @ center if center is not None else 0.0)

    def encode(batches):
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                score = np.maximum(kernels.matrix(part.column("_v")) @ w.T + shift, 0.0)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                val = np.take_along_axis(score, top, 1)
                r, c = np.nonzero(val > 0)
                ids = part.column("_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(feats[top[r, c]]), pa.array(val[r, c])], names=["id", "feature", "value"])

    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).alias("_v")).mapInArrow(encode, "id long, feature int, value double")


def reconstruct(acts: DataFrame, dictionary: DataFrame, decoder: str = "decoder", by: Sequence[str] = ()) -> DataFrame:
    """Sum of value x atom per row id (and group): (by..., id, recon)."""
    d = runtime.broadcast_checked(dictionary.select("feature", F.col(decoder).alias("_d")))
    part = acts.join(d, "feature").select(*by, "id", array_to_vector(F.transform("_d", lambda x: x * F.col("value"))).alias("_p"))
    return part.groupBy(*by, "id").agg(vector_to_array(Summarizer.sum(F.col("_p"))).alias("recon"))


def feature_moments(acts: DataFrame, n_rows: int) -> DataFrame:
    """Mean, population spread, energy and activity of every feature that fires, zeros included by count."""
    g = acts.groupBy("feature").agg(F.count(F.lit(1)).alias("nnz"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("energy"))
    mean = F.col("s") / n_rows
    return g.select("feature", "nnz", mean.alias("mean"), F.sqrt(F.greatest(F.col("energy") / n_rows - mean * mean, F.lit(0.0))).alias("std"), "energy")


def reconstruction_report(df: DataFrame, id_col: str, vec: str, acts: DataFrame, dictionary: DataFrame, decoder: str = "decoder") -> DataFrame:
    """Unexplained variance share, share of atoms that ever fire, and active features."""
    n = df.count()
    m = dictionary.count()
    rec = reconstruct(acts, dictionary, decoder)
    x = df.select(F.col(id_col).cast("long").alias("id"), vectors.as_double(vec).alias("_x"))
    j = x.join(rec, "id", "left").withColumn("_r", F.coalesce("recon", F.transform("_x", lambda t: F.lit(0.0))))
    err = j.agg(F.sum(F.pow(vectors.l2("_x", "_r"), 2)).alias("_e"))
    tot = V.dim_stats(df, vec).select((F.aggregate("std", F.lit(0.0), lambda a, s: a + s * s) * F.col("n")).alias("_t"))
    fm = feature_moments(acts, n).agg(F.count(F.lit(1)).alias("_a"), F.count_if(F.col("std") > ACTIVE_STD).alias("n_active"))
    one = err.crossJoin(F.broadcast(tot)).crossJoin(F.broadcast(fm))  # one row each
    return one.select((F.col("_e") / F.col("_t")).alias("fvu"), (F.col("_a") / F.lit(m)).alias("alive_share"), "n_active")


def long_labels(df: DataFrame, id_col: str, labels: Sequence[str]) -> DataFrame:
    """(id, label, y) for the labels each row carries."""
    pairs = [F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("y")) for c in labels]
    long = df.select(F.col(id_col).cast("long").alias("id"), F.explode(F.array(*pairs)).alias("p")).select("id", "p.label", "p.y")
    return long.where(F.col("y").isNotNull() & ~F.isnan("y"))


def feature_label_spearman(acts: DataFrame, labels: DataFrame) -> DataFrame:
    """Spearman of every firing feature with every label, average ties, over the rows that carry the label.

    A feature is zero on most rows. Those zeros share rank (n0 + 1) / 2, so only stored values are ranked and
    joined; the zeros enter through counts and the label-rank total.
    """
    ry = ranking.with_average_rank(labels, "y", "ry", ["label"]).select("id", "label", "ry")
    ry = runtime.cut_lineage(ry)
    tot = ry.groupBy("label").agg(F.count(F.lit(1)).alias("N"), F.sum("ry").alias("sy"), F.sum(F.col("ry") * F.col("ry")).alias("syy"))
    hit = acts.join(ry, "id")
    hit = runtime.cut_lineage(ranking.with_average_rank(hit, "value", "rv", ["label", "feature"]))
    g = hit.groupBy("feature", "label").agg(
        F.count(F.lit(1)).alias("k"), F.sum("rv").alias("sv"), F.sum(F.col("rv") * F.col("rv")).alias("svv"), F.sum(F.col("rv") * F.col("ry")).alias("svy"), F.sum("ry").alias("sky"),
    )
    j = g.join(F.broadcast(tot), "label")  # one row per label
    n0, n = F.col("N") - F.col("k"), F.col("N")
    r0 = (n0 + 1) / 2.0
    # Stored values rank after the zeros: shift by n0.
    sxx = F.col("svv") + 2 * n0 * F.col("sv") + F.col("k") * n0 * n0 + n0 * r0 * r0
    sxy = F.col("svy") + n0 * F.col("sky") + r0 * (F.col("sy") - F.col("sky"))
    mx, my = (n + 1) / 2.0, F.col("sy") / n
    cov, vx, vy = sxy / n - mx * my, sxx / n - mx * mx, F.col("syy") / n - my * my
    return j.select("feature", "label", n.alias("n"), F.col("k").alias("nnz"), F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy)).alias("rho"))


def correlation_pvalue(rho: str = "rho", n: str = "n"):
    r = F.least(F.abs(F.col(rho)), F.lit(1 - 1e-15))
    t = r * F.sqrt((F.col(n) - 2) / F.greatest(1 - r * r, F.lit(1e-15)))
    return t_pvalue(t, (F.col(n) - 2).cast("double"))


def align_features(spearman: DataFrame, active: DataFrame, n_labels: int) -> DataFrame:
    """Best label per active feature, Bonferroni over the labels, then BH over the active features."""
    s = spearman.where(F.col("rho").isNotNull()).withColumn("p", correlation_pvalue())
    best = s.groupBy("feature").agg(F.max_by("label", F.struct(F.abs("rho"), F.col("label"))).alias("best_label"), F.max(F.abs("rho")).alias("align"))
    p = inference.bonferroni(s, "feature", "p", n_labels)
    j = runtime.cut_lineage(best.join(p, "feature").join(active.select("feature"), "feature", "left_semi"))
    return j.join(inference.bh_qvalues(j, "p_item"), "p_item").select("feature", "best_label", "align", "p_item", "q")


def novelty(acts: DataFrame, df: DataFrame, id_col: str, labels: Sequence[str]) -> DataFrame:
    """Share of a feature's variance that a linear fit on the labels leaves, from sparse cross moments."""
    ok = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in labels]).dropna(subset=list(labels))
    m = V.moment_matrix(ok, None, list(labels))
    n = m[0, 0]
    mu = m[0] / n
    cov = (m / n - np.outer(mu, mu))[1:, 1:]
    inv = np.linalg.pinv(cov)
    a = acts.join(ok, "id")
    g = a.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), *[F.sum(F.col("value") * F.col(c)).alias(f"_{c}") for c in labels])
    c = [F.col(f"_{name}") / n - F.col("s") / n * F.lit(float(mu[1 + i])) for i, name in enumerate(labels)]
    quad = F.lit(0.0)
    for i in range(len(labels)):
        for j in range(len(labels)):
            quad = quad + c[i] * c[j] * F.lit(float(inv[i, j]))
    var = F.col("q") / n - F.pow(F.col("s") / n, 2)
    return g.select("feature", (1 - quad / F.greatest(var, F.lit(1e-12))).alias("novelty"))


def family_census(spearman: DataFrame, aligned: DataFrame, families: Mapping[str, str], q_cut: float = 0.05) -> DataFrame:
    """Which family of labels each aligned feature follows first, with counts per best label."""
    fam = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    names = sorted(set(families.values()))
    s = spearman.where(F.col("rho").isNotNull()).withColumn("family", fam[F.col("label")])
    top = s.groupBy("feature", "family").agg(F.max(F.struct(F.abs("rho").alias("a"), F.col("label").alias("l"))).alias("t"))
    wide = top.groupBy("feature").agg(*[F.max(F.when(F.col("family") == f, F.col("t"))).alias(f) for f in names])
    j = wide.join(aligned.where(F.col("q") <= q_cut).select("feature"), "feature", "left_semi")
    first = F.lit(names[0])
    best = F.col(f"{names[0]}.a")
    lab = F.col(f"{names[0]}.l")
    for f in names[1:]:
        better = F.coalesce(F.col(f"{f}.a") > best, best.isNull())
        first, lab, best = F.when(better, F.lit(f)).otherwise(first), F.when(better, F.col(f"{f}.l")).otherwise(lab), F.when(better, F.col(f"{f}.a")).otherwise(best)
    return j.select(first.alias("family"), lab.alias("label"), best.alias("a")).groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > 0.3).alias("n_strong"))


def recurrence(a: DataFrame, b: DataFrame, decoder: str = "decoder") -> DataFrame:
    """Largest |cosine| of each atom of one dictionary with any atom of another: (feature, best).

    The other dictionary enters with both signs, so this is a one-neighbour search in the tiled join.
    """
    q = a.select(F.col("feature").cast("long").alias("f"), vectors.as_double(decoder).alias("v"))
    both = b.select(F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("s"), F.col("feature"), vectors.as_double(decoder).alias("_v"))
    base = both.select((F.col("feature").cast("long") * 2 + F.when(F.col("s") > 0, 1).otherwise(0)).alias("f"), F.transform("_v", lambda x: x * F.col("s")).alias("v"))
    near = knn.knn_join(q, base, 1, "f", "v", metric="cosine", exclude_self=False)
    return near.select(F.col("src").cast("int").alias("feature"), (1 - F.col("dist")).alias("best"))


def recurrence_share(best: DataFrame, cut: float = 0.6) -> DataFrame:
    return best.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("best") >= cut).cast("double")).alias("share"), F.percentile("best", 0.5).alias("median_best"))


def activation_match(a: DataFrame, b: DataFrame, n_rows: int) -> DataFrame:
    """Largest |correlation| of each feature of one model with any of another over shared rows.

    Only features that fire on the same row meet (at most k x k pairs a row, combined before the shuffle). A
    feature pair that never fires together has correlation -mean mean / (std std); the best such partner is the
    first one, in order of mean / std, that is missing from the feature's partner set.
    """
    ma, mb = feature_moments(a, n_rows), feature_moments(b, n_rows)
    ma, mb = ma.where(F.col("std") > ACTIVE_STD), mb.where(F.col("std") > ACTIVE_STD)
    pair = a.select("id", F.col("feature").alias("fa"), F.col("value").alias("va")).join(b.select("id", F.col("feature").alias("fb"), F.col("value").alias("vb")), "id")
    co = pair.groupBy("fa", "fb").agg(F.sum(F.col("va") * F.col("vb")).alias("s"))
    j = co.join(ma.select(F.col("feature").alias("fa"), F.col("mean").alias("ma"), F.col("std").alias("sa")), "fa").join(
        mb.select(F.col("feature").alias("fb"), F.col("mean").alias("mb"), F.col("std").alias("sb")), "fb"
    )
    corr = (F.col("s") / n_rows - F.col("ma") * F.col("mb")) / (F.col("sa") * F.col("sb"))
    met = j.groupBy("fa").agg(F.max(F.abs(corr)).alias("met"), F.collect_set("fb").alias("_set"))  # at most the dictionary size
    order = mb.agg(F.sort_array(F.collect_list(F.struct((F.col("mean") / F.col("std")).alias("r"), F.col("feature").alias("f"))), asc=False).alias("_o"))
    full = ma.select(F.col("feature").alias("fa"), (F.col("mean") / F.col("std")).alias("ra")).join(met, "fa", "left").crossJoin(F.broadcast(order))  # one row
    absent = F.array_except(F.transform("_o", lambda t: t["f"]), F.coalesce("_set", F.array().cast("array<int>")))
    ratio = F.map_from_entries(F.transform("_o", lambda t: F.struct(t["f"], t["r"])))
    never = F.when(F.size(absent) > 0, F.col("ra") * F.element_at(ratio, F.get(absent, F.lit(0))))
    return full.select(F.col("fa").alias("feature"), F.greatest(F.coalesce("met", F.lit(0.0)), F.coalesce(never, F.lit(0.0))).alias("best"))


def shuffle_rows(acts: DataFrame, ids: DataFrame, seed) -> DataFrame:
    """The same activations on permuted row ids: the chance baseline of a row-wise match."""
    i = ids.select(F.col(ids.columns[0]).cast("long").alias("id"))
    a = ranking.hash_order(i, "id", f"{seed}a", out="_r")
    b = ranking.hash_order(i, "id", f"{seed}b", out="_r").select("_r", F.col("id").alias("_to"))
    return acts.join(a.join(b, "_r").select("id", "_to"), "id").select(F.col("_to").alias("id"), "feature", "value")


def dictionary_clusters(dictionary: DataFrame, tau: float, k: int = 2, min_members: int = 2, decoder: str = "decoder") -> DataFrame:
    """(feature, cluster): k nearest atoms by cosine, edges below ``tau`` pruned, connected components."""
    d = dictionary.select(F.col("feature").cast("long").alias("f"), vectors.as_double(decoder).alias("v"))
    return clusters_of_edges(knn.knn_join(d, d, k, "f", "v", metric="cosine"), tau, min_members)


def clusters_of_edges(edges: DataFrame, tau: float, min_members: int = 2) -> DataFrame:
    e = edges.where(1 - F.col("dist") >= tau)
    c = graph.components(e, u="src", v="dst")
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= min_members)
    return c.join(size, "component").select(F.col("node").cast("int").alias("feature"), F.col("component").cast("int").alias("cluster"), "members")


def tau_sweep(dictionary: DataFrame, taus: Sequence[float], k: int = 2, min_members: int = 2, decoder: str = "decoder") -> DataFrame:
    d = dictionary.select(F.col("feature").cast("long").alias("f"), vectors.as_double(decoder).alias("v"))
    edges = runtime.cut_lineage(knn.knn_join(d, d, k, "f", "v", metric="cosine"))
    out = None
    for tau in taus:
        c = clusters_of_edges(edges, tau, min_members)
        one = c.agg(F.count_distinct("cluster").alias("n_clusters"), F.coalesce(F.max("members"), F.lit(0)).alias("largest")).withColumn("tau", F.lit(float(tau)))
        out = one if out is None else out.unionByName(one)
    return out


def cluster_components(acts: DataFrame, clusters: DataFrame, dictionary: DataFrame, n_components: int = 4, decoder: str = "decoder") -> DataFrame:
    """Row scores (cluster, id, score array) on the leading axes of each cluster's own reconstruction.

    The reconstruction lives in the span of the cluster's atoms, so its axes follow from the member-by-member
    co-moments of the activations (sparse sums) and the atoms; one small task per cluster solves them.
    """
    a = acts.join(F.broadcast(clusters.select("feature", "cluster")), "feature").where(F.col("value") > 0)  # one row per atom
    n = a.select("cluster", "id").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("n_active"))
    x, y = a.select("cluster", "id", F.col("feature").alias("fa"), F.col("value").alias("va")), a.select("cluster", "id", F.col("feature").alias("fb"), F.col("value").alias("vb"))
    co = x.join(y, ["cluster", "id"]).groupBy("cluster", "fa", "fb").agg(F.sum(F.col("va") * F.col("vb")).alias("s"))
    co = co.select(*[F.col(c).alias(c) for c in co.columns])  # fresh column identities for the cogroup
    one = a.groupBy("cluster", "feature").agg(F.sum("value").alias("s"))
    mem = one.join(n, "cluster").join(dictionary.select("feature", vectors.as_double(decoder).alias("_d")), "feature")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        f = left.column("feature").to_numpy()
        o = np.argsort(f)
        f = f[o]
        d = kernels.matrix(left.column("_d"))[o]
        n_act = float(left.column("n_active")[0].as_py())
        mean = left.column("s").to_numpy()[o] / n_act
        c = np.zeros((len(f), len(f)))
        c[np.searchsorted(f, right.column("fa").to_numpy()), np.searchsorted(f, right.column("fb").to_numpy())] = right.column("s").to_numpy()
        cov = c / n_act - np.outer(mean, mean)
        w, u = np.linalg.eigh(cov)
        half = u * np.sqrt(np.maximum(w, 0.0)) @ u.T
        lam, q = np.linalg.eigh(half @ (d @ d.T) @ half)
        keep = min(n_components, len(f))
        top = np.argsort(lam)[::-1][:keep]
        axes = d.T @ (half @ q[:, top]) / np.sqrt(np.maximum(lam[top], 1e-300))
        load = d @ axes  # score of one unit of each member
        sgn = np.sign(load[np.abs(load).argmax(0), np.arange(keep)])
        load = load * np.where(sgn == 0, 1.0, sgn)
        load = np.hstack([load, np.zeros((len(f), n_components - keep))])
        return pa.Table.from_arrays(
            [pa.array(np.full(len(f), left.column("cluster")[0].as_py(), np.int32)), pa.array(f.astype(np.int32)), kernels.lists(load), kernels.lists(np.tile(mean @ load, (len(f), 1)))],
            names=["cluster", "feature", "load", "center"],
        )

    schema = "cluster int, feature int, load array<double>, center array<double>"
    loads = mem.groupBy("cluster").cogroup(co.groupBy("cluster")).applyInArrow(solve, schema)
    loads = runtime.cut_lineage(loads)
    s = a.join(F.broadcast(loads), ["cluster", "feature"])  # one row per atom
    tot = s.groupBy("cluster", "id").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.transform("load", lambda t: t * F.col("value"))))).alias("_t"), F.first("center").alias("_c")
    )
    return tot.select("cluster", "id", vectors.subtract("_t", "_c").alias("score"))


def normalised_pair(scores: DataFrame, i: int = 0, j: int = 1) -> DataFrame:
    """Two score components per cluster, mean removed and scaled to a mean square length of two: (cluster, id, x, y)."""
    s = scores.select("cluster", "id", F.col("score")[i].alias("x"), F.col("score")[j].alias("y"))
    st = s.groupBy("cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    scale = F.lit(math.sqrt(2.0)) / (F.sqrt(F.col("vx") + F.col("vy")) + 1e-12)
    j2 = s.join(runtime.broadcast_checked(st), "cluster")
    return j2.select("cluster", "id", ((F.col("x") - F.col("mx")) * scale).alias("x"), ((F.col("y") - F.col("my")) * scale).alias("y"))


# Tasks that count one cluster, rows turned at once, and ranges of a projection that the bounds of the mixture index count.
CLUSTER_TASKS = 16
TURNED = 512
RANGES = 4096


def _spread_clusters(pairs: DataFrame, *columns: str) -> DataFrame:
    """Rows of a cluster in at most CLUSTER_TASKS tasks, side by side, so that each task counts a cluster once."""
    salt = F.pmod(F.xxhash64("id"), F.lit(CLUSTER_TASKS))
    return pairs.select("cluster", "x", "y", *columns, salt.alias("_salt")).repartition("cluster", "_salt").sortWithinPartitions("cluster").drop("_salt")


def _per_cluster(batches, add, emit):
    """Feed each cluster's rows, which come one after the other, to ``add``; ``emit`` what it held when the next cluster begins."""
    held, at = None, None
    for b in batches:
        cluster = b.column("cluster").to_numpy()
        for low, high in zip(*[(lambda c: (c[:-1], c[1:]))(np.r_[0, np.flatnonzero(np.diff(cluster)) + 1, len(cluster)])][0]) if len(cluster) else ():
            if held is not None and cluster[low] != at:
                yield emit(at, held)
                held = None
            at = cluster[low]
            for s in range(low, high, TURNED):
                held = add(held, b.slice(s, min(TURNED, high - s)))
    if held is not None:
        yield emit(at, held)


def separability(pairs: DataFrame, n_angles: int = 1000, bins: int = 40, clip: float = 3.0) -> DataFrame:
    """Smallest binned mutual information (bits) of the two coordinates over rotations, per cluster.

    A task turns its rows by all angles and counts cells, so rows are not copied per angle; what it passes on is at most one count per angle and cell.
    """
    th = np.arange(n_angles) * (math.pi / n_angles)
    cos, sin = np.cos(th), np.sin(th)

    def add(held, b):
        held = np.zeros(n_angles * bins * bins, np.int64) if held is None else held
        x, y = b.column("x").to_numpy()[:, None], b.column("y").to_numpy()[:, None]
        u, v = x * cos + y * sin, y * cos - x * sin
        r, a = np.nonzero((np.abs(u) < clip) & (np.abs(v) < clip))
        cell = lambda c: np.clip(((c[r, a] + clip) / (2 * clip) * bins).astype(np.int64), 0, bins - 1)
        np.add.at(held, (a * bins + cell(u)) * bins + cell(v), 1)
        return held

    def emit(cluster, held):
        at = np.flatnonzero(held)
        columns = [np.full(len(at), cluster), at // (bins * bins), at // bins % bins, at % bins]
        return pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in columns], pa.array(held[at])], names=["cluster", "a", "iu", "iv", "n"])

    counts = _spread_clusters(pairs).mapInArrow(lambda batches: _per_cluster(batches, add, emit), "cluster int, a int, iu int, iv int, n long")
    h = counts.groupBy("cluster", "a", "iu", "iv").agg(F.sum("n").cast("double").alias("n"))
    w = Window.partitionBy("cluster", "a")  # bins x bins cells
    p = h.withColumns({"t": F.sum("n").over(w), "nu": F.sum("n").over(w.partitionBy("cluster", "a", "iu")), "nv": F.sum("n").over(w.partitionBy("cluster", "a", "iv"))})
    mi = p.groupBy("cluster", "a").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nu") * F.col("nv")))).alias("mi"))
    return mi.groupBy("cluster").agg((F.min("mi") / F.lit(math.log(2.0))).alias("separability"))


def _best_band(rows: DataFrame, open_: DataFrame, eps: float) -> DataFrame:
    """Largest share of rows (cluster, x, y) in the bands (cluster, phi, prob) and its direction, per cluster: exact, each row once per direction."""
    on = lambda a, b: a.join(b.select(F.col("cluster").alias("_c"), F.col("phi").alias("_phi"), *[c for c in b.columns if c not in ("cluster", "phi")]), (F.col("cluster") == F.col("_c")) & (F.col("phi") == F.col("_phi"))).drop("_c", "_phi")
    turn = open_.select(F.col("cluster").alias("_t"), "phi").distinct()
    p = rows.join(turn, F.col("cluster") == F.col("_t")).select("cluster", "phi", (F.col("x") * F.cos("phi") + F.col("y") * F.sin("phi")).alias("p"))
    p = runtime.cut_lineage(p)
    st = p.groupBy("cluster", "phi").agg(F.avg("p").alias("mu"), F.var_samp("p").alias("var"))
    ranks = on(ranking.value_ranks(p, "p", ["cluster", "phi"]), open_).withColumn("pos", F.col("prob") * (F.col("total") - 1))
    at = lambda pos: F.max(F.when((F.col("before") <= pos) & (pos < F.col("before") + F.col("n")), F.col("p")))
    q = ranks.groupBy("cluster", "phi", "prob").agg(at(F.floor("pos")).alias("lo"), at(F.ceil("pos")).alias("hi"), F.max(F.col("pos") - F.floor("pos")).alias("f"))
    cuts = on(q.select("cluster", "phi", "prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f")).alias("q")), st)
    near = F.abs(F.col("p") - F.col("q")) < eps * F.sqrt(F.col("var") + F.pow(F.col("mu") - F.col("q"), 2))
    share = on(p, runtime.cut_lineage(cuts)).groupBy("cluster", "phi", "prob").agg(F.avg(near.cast("double")).alias("m"))
    return share.groupBy("cluster").agg(F.max(F.struct("m", "phi")).alias("b")).select("cluster", "b.m", F.col("b.phi").alias("at"))


def _offset_probs(offsets: int) -> np.ndarray:
    return np.array([0.005 + 0.99 * i / (offsets - 1) for i in range(offsets)])


def _band_bounds(counts: np.ndarray, low: np.ndarray, step: np.ndarray, mu: np.ndarray, var: np.ndarray, eps: float, offsets: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the shares (directions x offsets), from counts (directions x ranges) alone; ranges are widened by one for rounding."""
    m, ranges = counts.shape
    total = np.concatenate([np.zeros((m, 1)), np.cumsum(counts, axis=1)], axis=1)
    n = total[:, -1:]
    pos = _offset_probs(offsets) * (n - 1)
    first = np.stack([np.searchsorted(t[1:], np.floor(p), side="right") for t, p in zip(total, pos)])
    last = np.stack([np.searchsorted(t[1:], np.ceil(p), side="right") for t, p in zip(total, pos)])
    low, step, mu, var = (c[:, None] for c in (low, step, mu, var))
    q0, q1 = low + step * (first - 1), low + step * (last + 2)
    near = np.where((q0 <= mu) & (mu <= q1), 0.0, np.minimum(np.abs(q0 - mu), np.abs(q1 - mu)))
    far = np.maximum(np.abs(q0 - mu), np.abs(q1 - mu))
    w0, w1 = (eps * np.sqrt(np.maximum(var, 0.0) + d * d) * f for d, f in ((near, 1 - 1e-9), (far, 1 + 1e-9)))
    inside = lambda lo, hi: np.take_along_axis(total, np.clip(hi, 0, ranges), 1) - np.take_along_axis(total, np.clip(np.minimum(lo, hi), 0, ranges), 1)
    at = lambda v: (v - low) / step
    most = inside(np.floor(at(q0 - w1)).astype(int) - 1, np.ceil(at(q1 + w1)).astype(int) + 1)
    least = inside(np.ceil(at(q1 - w0)).astype(int) + 1, np.floor(at(q0 + w0)).astype(int) - 1)
    return least / n, most / n


def _open_bands(pairs: DataFrame, first: str, width: float, n: int, eps: float, offsets: int) -> DataFrame:
    """(cluster, phi, prob) of the bands at directions ``first`` + i * width, i < n, and percentiles whose upper bound reaches the best lower bound of their cluster.

    A task projects its rows on all directions and counts RANGES ranges of each; no row is copied. Mean and variance of a projection follow from the
    plane's moments.
    """
    st = pairs.groupBy("cluster").agg(
        F.max(F.hypot("x", "y")).alias("r"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"), F.max(first).alias("first"),
    )
    st = runtime.cut_lineage(st)
    rows = _spread_clusters(pairs.join(st.select(F.col("cluster").alias("_c"), "r"), F.col("cluster") == F.col("_c")), first, "r")
    step, probs = np.arange(n) * width, _offset_probs(offsets)

    def add(held, b):
        held = np.zeros((n, RANGES), np.int64) if held is None else held
        x, y, r, phi = b.column("x").to_numpy()[:, None], b.column("y").to_numpy()[:, None], b.column("r").to_numpy()[:, None], b.column(first).to_numpy()[:, None] + step
        p = np.clip(((x * np.cos(phi) + y * np.sin(phi)) / np.maximum(r, 1e-300) + 1) * (RANGES / 2), 0, RANGES - 1).astype(np.int64)
        np.add.at(held, (np.broadcast_to(np.arange(n), p.shape), p), 1)
        return held

    def emit(cluster, held):
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, cluster, np.int32)), pa.array(np.arange(n, dtype=np.int32)), kernels.lists(held)], names=["cluster", "i", "counts"])

    counts = rows.mapInArrow(lambda batches: _per_cluster(batches, add, emit), "cluster int, i int, counts array<double>")
    counts = counts.groupBy("cluster", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("counts"))).alias("counts"))
    counts = counts.join(st.select(F.col("cluster").alias("_c"), *[c for c in st.columns if c != "cluster"]), F.col("cluster") == F.col("_c"))

    def bound(batches):
        for b in batches:
            if b.num_rows:
                i, r, phi0, mx, my, vx, vy, vxy = (b.column(c).to_numpy().astype(float) for c in ("i", "r", "first", "mx", "my", "vx", "vy", "vxy"))
                phi = phi0 + i * width
                c, s = np.cos(phi), np.sin(phi)
                r = np.maximum(r, 1e-300)
                low, high = _band_bounds(kernels.matrix(b.column("counts")), -r, 2 * r / RANGES, mx * c + my * s, np.nan_to_num(vx * c * c + vy * s * s + 2 * vxy * c * s), eps, offsets)
                each = np.repeat(np.arange(len(phi)), offsets)
                yield pa.RecordBatch.from_arrays([b.column("cluster").take(pa.array(each)), pa.array(phi[each]), pa.array(np.tile(probs, len(phi))), pa.array(low.ravel()), pa.array(high.ravel())], names=["cluster", "phi", "prob", "low", "high"])

    bounds = runtime.cut_lineage(counts.mapInArrow(bound, "cluster int, phi double, prob double, low double, high double"))
    floor = bounds.groupBy(F.col("cluster").alias("_c")).agg(F.max("low").alias("floor"))
    return bounds.join(floor, F.col("cluster") == F.col("_c")).where("high >= floor").select("cluster", "phi", "prob")


def mixture_index(pairs: DataFrame, eps: float = 0.1, n_phi: int = 360, n_offsets: int = 61, refine: tuple[int, int] = (40, 121)) -> DataFrame:
    """Largest share of rows in a band |v.f + c| < eps RMS(v.f + c) over directions and offsets, per cluster: a
    full grid, then a finer one around each cluster's best direction.

    Counts of all directions bound every share from both sides; rows are looked at again only for the bands that can still be the best, which
    are few. The result is that of the full grids.
    """
    pairs = runtime.cut_lineage(pairs.select(F.col("cluster").cast("int").alias("cluster"), "id", "x", "y"))
    step = math.pi / n_phi
    n_fine, off_fine = refine

    def best(rows: DataFrame, first: str, width: float, n: int, offsets: int) -> DataFrame:
        return runtime.cut_lineage(_best_band(rows, runtime.cut_lineage(_open_bands(rows, first, width, n, eps, offsets)), eps))

    coarse = best(pairs.withColumn("from", F.lit(0.0)), "from", step, n_phi, n_offsets)
    around = coarse.select(F.col("cluster").alias("_a"), (F.col("at") - step).alias("from"))
    fine = best(pairs.join(around, F.col("cluster") == F.col("_a")).drop("_a"), "from", 2 * step / (n_fine - 1), n_fine, off_fine)
    return coarse.join(fine.select("cluster", F.col("m").alias("m2")), "cluster").select("cluster", F.greatest("m", "m2").alias("mixture"))


def plane_fit(pairs: DataFrame, labels: DataFrame, id_col: str, names: Sequence[str], min_rows: int = 300) -> DataFrame:
    """R2 of every label on the two coordinates (a, b), per cluster with at least ``min_rows`` labelled rows."""
    p = pairs.select("cluster", "id", F.col("x").alias("a"), F.col("y").alias("b"))
    g = p.join(long_labels(labels, id_col, names), "id").groupBy("cluster", "label").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("a").alias("aa"), F.var_pop("b").alias("bb"), F.covar_pop("a", "b").alias("ab"),
        F.covar_pop("a", "y").alias("ay"), F.covar_pop("b", "y").alias("by"), F.var_pop("y").alias("yy"),
    ).where(F.col("n") >= min_rows)
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    num = F.col("bb") * F.col("ay") * F.col("ay") - 2 * F.col("ab") * F.col("ay") * F.col("by") + F.col("aa") * F.col("by") * F.col("by")
    return g.select("cluster", "label", "n", (num / (det * F.col("yy"))).alias("r2"))


def ablate(df: DataFrame, id_col: str, vec: str, acts: DataFrame, features: DataFrame, dictionary: DataFrame, decoder: str = "decoder") -> DataFrame:
    """The table with the chosen features' contribution subtracted from its vectors."""
    part = acts.join(F.broadcast(features.select("feature")), "feature", "left_semi")  # at most the dictionary size
    rec = reconstruct(part, dictionary, decoder).withColumnRenamed("id", "_rid")
    j = df.join(rec, F.col(id_col) == F.col("_rid"), "left")
    out = F.when(F.col("recon").isNotNull(), vectors.subtract(vec, "recon")).otherwise(vectors.as_double(vec))
    return j.withColumn(vec, out).drop("recon", "_rid")


def matched_controls(moments: DataFrame, chosen: DataFrame, n_controls: int, seed=0) -> DataFrame:
    """Random feature sets with the chosen set's histogram over deciles of log energy: (control, feature).

    A decile with too few candidates draws from the whole pool, as the sampling it mirrors does.
    """
    active = moments.where(F.col("std") > ACTIVE_STD).withColumn("le", F.log10(F.col("energy") + 1e-12))
    pool = runtime.cut_lineage(active.join(chosen.select("feature"), "feature", "left_anti"))
    edges = [float(x) for x in ranking.quantiles(pool, "le", [i / 10 for i in range(11)]).first()]
    b = F.lit(-1)
    for e in edges:
        b = b + (F.col("le") >= e).cast("int")
    b = F.least(F.greatest(b, F.lit(0)), F.lit(9))
    need = active.join(chosen.select("feature"), "feature", "left_semi").groupBy(b.alias("decile")).agg(F.count(F.lit(1)).alias("need"))
    have = pool.groupBy(b.alias("decile")).agg(F.count(F.lit(1)).alias("have"))
    plan = need.join(have, "decile", "left").select("decile", "need", (F.coalesce("have", F.lit(0)) >= F.col("need")).alias("own"))
    draws = F.explode(F.sequence(F.lit(0), F.lit(n_controls - 1))).alias("control")
    own = pool.select("feature", b.alias("decile")).join(F.broadcast(plan.where("own")), "decile").select("*", draws)
    short = plan.where(~F.col("own")).agg(F.collect_list(F.struct("decile", "need")).alias("_s"))  # ten entries at most
    wide = pool.select("feature").crossJoin(F.broadcast(short)).select("feature", F.explode("_s").alias("p")).select("feature", "p.decile", "p.need", draws)
    rows = own.select("control", "decile", "need", "feature").unionByName(wide.select("control", "decile", "need", "feature"))
    keyed = rows.withColumn("_k", F.concat_ws(":", "control", "decile", "feature"))
    return ranking.hash_order(keyed, "_k", seed, ["control", "decile"]).where(F.col("rn") <= F.col("need")).select("control", "feature").distinct()


# ---- one-dimensional mixtures -------------------------------------------------------------------------------

# Ranges that the first fit of a mixture sees, and its steps.
MIXTURE_RANGES, MIXTURE_STEPS = 65_536, 5_000


def _shares(x: np.ndarray, p: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the first component and log density at ``x``; ``p`` holds (mean, variance, share) twice."""
    (m0, v0, w0), (m1, v1, w1) = p
    l0, l1 = (math.log(w / math.sqrt(2 * math.pi * v)) - (x - m) ** 2 / (2 * v) for m, v, w in ((m0, v0, w0), (m1, v1, w1)))
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(l1 - l0)), np.maximum(l0, l1) + np.log1p(np.exp(-np.abs(l1 - l0)))


def _refit(n: float, x: float, xx: float, r: float, rx: float, rxx: float) -> tuple:
    """Both components from the sums of 1, x and x^2 over all rows and over the first component's shares."""
    out = []
    for a, b, c in ((r, rx, rxx), (n - r, x - rx, xx - rxx)):
        out.append((b / a, max(c / a - (b / a) ** 2, 1e-300), a / n))
    return tuple(out)


def two_component_cut(df: DataFrame, value: str, max_iter: int = 200, tol: float = 1e-6) -> dict:
    """Means, spreads, shares of a two-component mixture and the posterior crossing between the means.

    Expectation maximisation starts on counts of MIXTURE_RANGES ranges, from their two means, and goes on over all rows until a pass changes
    their log likelihood by no more than ``tol`` (or its rounding): a few passes, whatever the number of rows. Values that are NULL, NaN or infinite
    are left out.
    """
    rows = runtime.cut_lineage(df.select(F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))))
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not one["n"] or one["lo"] == one["hi"]:
        raise ValueError("a mixture needs two different values")
    mean, width = one["mean"], (one["hi"] - one["lo"]) / MIXTURE_RANGES
    x = F.col("x") - F.lit(mean)
    bins = rows.groupBy(F.least(F.floor((F.col("x") - F.lit(one["lo"])) / F.lit(width)), F.lit(MIXTURE_RANGES - 1)).alias("bin"))
    ranges = bins.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x")).collect()  # MIXTURE_RANGES rows at most
    at, many = np.array([r["x"] for r in ranges]), np.array([r["n"] for r in ranges], float)
    total = many.sum(), many @ at, many @ at**2
    share = (at < 0).astype(float)
    for _ in range(MIXTURE_STEPS):  # two means
        w = many * share
        before, share = share, (at < (w @ at / w.sum() + (total[1] - w @ at) / (total[0] - w.sum())) / 2).astype(float)
        if (before == share).all():
            break
    for _ in range(MIXTURE_STEPS):
        w = many * share
        p = _refit(*total, w.sum(), w @ at, w @ at**2)
        before, share = share, _shares(at, p)[0]
        if np.abs(share - before).max() < 1e-13:
            break
    last = None
    for _ in range(max_iter):
        logs = [F.lit(math.log(w / math.sqrt(2 * math.pi * v))) - (x - F.lit(m)) ** 2 / F.lit(2 * v) for m, v, w in p]
        first = 1 / (1 + F.exp(logs[1] - logs[0]))
        density = F.greatest(*logs) + F.log1p(F.exp(-F.abs(logs[1] - logs[0])))
        terms = rows.select(x.alias("x"), first.alias("r"), density.alias("l"))
        s = terms.agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum("r").alias("r"), F.sum(F.col("r") * F.col("x")).alias("rx"), F.sum(F.col("r") * F.col("x") * F.col("x")).alias("rxx"), F.sum("l").alias("l")).first()
        if last is not None and abs(s["l"] - last) <= max(tol, 1e-14 * abs(s["l"])):
            break
        p, last = _refit(one["n"], s["x"], s["xx"], s["r"], s["rx"], s["rxx"]), s["l"]
    runtime.discard(rows)
    (m0, v0, w0), (m1, v1, w1) = sorted((m + mean, v, w) for m, v, w in p)
    a = 0.5 / v1 - 0.5 / v0
    b = m0 / v0 - m1 / v1
    c = 0.5 * m1 * m1 / v1 - 0.5 * m0 * m0 / v0 + math.log(w0 / w1) - 0.5 * math.log(v0 / v1)
    roots = [-c / b] if abs(a) < 1e-15 else [r.real for r in np.roots([a, b, c]) if abs(r.imag) < 1e-9]
    inside = [r for r in roots if m0 <= r <= m1]
    cut = inside[0] if inside else 0.5 * (m0 + m1)
    return {"low": m0, "high": m1, "var_low": v0, "var_high": v1, "share_low": w0, "cut": float(cut)}
