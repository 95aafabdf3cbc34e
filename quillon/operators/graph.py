"""Graphs from neighbour edges: dimension estimators, curvature, components, spanning forests, geodesics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import hashing, scalars, vectors
from quillon.operators import kernels, ranking
from quillon.runtime import cut_lineage, discard

TINY = 1e-12


def symmetrise(edges: DataFrame, weight: str = "dist", keep: str = "max") -> DataFrame:
    """Both directions of every edge once, with the largest (or smallest) weight: (u, v, w)."""
    fwd = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col(weight).alias("w"))
    back = fwd.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")
    agg = F.max("w") if keep == "max" else F.min("w")
    return fwd.unionByName(back).groupBy("u", "v").agg(agg.alias("w"))


# ---- intrinsic dimension ------------------------------------------------------------------------------------

def neighbour_ratio(edges: DataFrame, first: int, second: int, by: Sequence[str] = ()) -> DataFrame:
    """log(d_second / d_first) per source where the ratio exceeds one, from one grouped pass over the edges."""
    by = list(by)
    d = edges.where(F.col("rank").isin(first, second)).groupBy(*by, "src").agg(
        F.max(F.when(F.col("rank") == first, F.col("dist"))).alias("_a"), F.max(F.when(F.col("rank") == second, F.col("dist"))).alias("_b")
    )
    ratio = F.col("_b") / F.greatest("_a", F.lit(TINY))
    return d.select(*by, "src", ratio.alias("mu")).where(F.col("mu") > 1).withColumn("log_mu", F.log("mu"))


def twonn(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two-neighbour dimension (n - 1) / sum log mu, with the slope of the linear form below F = 0.9."""
    by = list(by)
    r = neighbour_ratio(edges, 1, 2, by)
    mle = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("log_mu").alias("_s"))
    mle = mle.select(*by, "n", F.col("_s").alias("sum_log"), ((F.col("n") - 1) / F.col("_s")).alias("mle"))
    c = ranking.ecdf(r, "log_mu", by).where(F.col("cdf") < 0.9)
    lin = c.groupBy(*by).agg((F.sum(F.col("log_mu") * -F.log(1 - F.col("cdf"))) / F.sum(F.col("log_mu") * F.col("log_mu"))).alias("linear"))
    return mle.join(lin, by) if by else mle.crossJoin(F.broadcast(lin))


def twonn_posterior(row_n: int, row_sum: float) -> tuple[float, float]:
    """95% posterior interval of the two-neighbour estimate: Gamma(n, 1 / sum log mu)."""
    from quillon.functions.special import gamma_quantile

    return gamma_quantile(0.025, row_n) / row_sum, gamma_quantile(0.975, row_n) / row_sum


def local_mle(edges: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Local maximum-likelihood dimension per source for several neighbourhood sizes: (k, src, m)."""
    logs = edges.withColumn("_l", F.log(F.greatest("dist", F.lit(TINY))))
    per = logs.groupBy("src").agg(
        *[F.max(F.when(F.col("rank") == k, F.log("dist"))).alias(f"_t{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") < k, F.col("_l"))).alias(f"_s{k}") for k in ks],
    )
    rows = [F.struct(F.lit(k).alias("k"), (F.lit(k - 1) * F.col(f"_t{k}") - F.col(f"_s{k}")).alias("s")) for k in ks]
    long = per.select("src", F.explode(F.array(*rows)).alias("p")).select("src", "p.k", "p.s").where(F.col("s").isNotNull())
    return long.select("k", "src", ((F.col("k") - 2) / F.greatest("s", F.lit(TINY))).alias("m"))


def local_mle_pooled(edges: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Harmonic pooling of the local estimates per neighbourhood size."""
    return local_mle(edges, ks).groupBy("k").agg(F.count(F.lit(1)).alias("n"), (1 / F.avg(1 / F.col("m"))).alias("dimension"))


def gride(edges: DataFrame, scales: Sequence[int]) -> DataFrame:
    """Scale curve from neighbour orders (n, 2n): the digamma difference is the sum of 1/j for j in [n, 2n)."""
    per = edges.groupBy("src").agg(*[F.max(F.when(F.col("rank") == r, F.col("dist"))).alias(f"_d{r}") for r in sorted({*scales, *[2 * s for s in scales]})])
    rows = [
        F.struct(F.lit(s).alias("scale"), (F.col(f"_d{2 * s}") / F.greatest(f"_d{s}", F.lit(TINY))).alias("mu"), F.lit(sum(1.0 / j for j in range(s, 2 * s))).alias("h"))
        for s in scales
    ]
    long = per.select(F.explode(F.array(*rows)).alias("p")).select("p.*").where(F.col("mu") > 1)
    return long.groupBy("scale").agg(F.count(F.lit(1)).alias("n"), (F.max("h") / F.avg(F.log("mu"))).alias("dimension"))


# ---- hyperbolicity ------------------------------------------------------------------------------------------

def indexed(df: DataFrame, id_col: str, seed=0) -> DataFrame:
    """Dense row index 0..n-1 in hash order."""
    return ranking.hash_order(df, id_col, seed, out="_rn").withColumn("row", (F.col("_rn") - 1).cast("long")).drop("_rn")


def random_tuples(spark, n_draws: int, n_rows: int, width: int, seed) -> DataFrame:
    """n_draws tuples of row indices with replacement, chosen by hash."""
    picks = [F.floor(hashing.uniform(f"{seed}-{j}", "id") * n_rows).cast("long").alias(f"r{j}") for j in range(width)]
    return spark.range(n_draws).select(F.col("id").alias("draw"), *picks)


def _with_vectors(tuples: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    for j in range(width):
        tuples = tuples.join(rows.select(F.col("row").alias(f"r{j}"), F.col("_v").alias(f"v{j}")), f"r{j}")
    return tuples


def delta_hyperbolicity(df: DataFrame, id_col: str, vec: str, n_quads: int, n_pairs: int = 100_000, metric: str = "euclidean", seed=0) -> DataFrame:
    """Four-point delta on random quadruples over the largest of ``n_pairs`` random pair distances."""
    spark = df.sparkSession
    v = vectors.normalise(vec) if metric == "cosine" else vectors.as_double(vec)
    rows = cut_lineage(indexed(df.select(id_col, v.alias("_v")), id_col, seed))
    n = rows.count()
    dist = (lambda a, b: 1 - vectors.dot(a, b)) if metric == "cosine" else vectors.l2
    diam = _with_vectors(random_tuples(spark, n_pairs, n, 2, f"{seed}p"), rows, 2).agg(F.max(dist("v0", "v1")).alias("diameter"))
    q = _with_vectors(random_tuples(spark, n_quads, n, 4, f"{seed}q"), rows, 4)
    sums = F.array(dist("v0", "v1") + dist("v2", "v3"), dist("v0", "v2") + dist("v1", "v3"), dist("v0", "v3") + dist("v1", "v2"))
    s = F.sort_array(sums, asc=False)
    return _delta_summary(q.select(((s[0] - s[1]) / 2).alias("raw")), diam)


def delta_hyperbolicity_tree(df: DataFrame, id_col: str, n_quads: int, seed=0) -> DataFrame:
    """The same statistic on exact path distances of the binary tree whose nodes are the table's rows, laid out in hash order: zero."""
    spark = df.sparkSession
    rows = cut_lineage(indexed(df.select(id_col), id_col, seed).select("row"))
    n = rows.count()
    d = scalars.heap_distance
    q = random_tuples(spark, n_quads, n, 4, f"{seed}q")
    for j in range(4):
        q = q.join(rows.withColumnRenamed("row", f"r{j}"), f"r{j}")
    s = F.sort_array(F.array(d("r0", "r1") + d("r2", "r3"), d("r0", "r2") + d("r1", "r3"), d("r0", "r3") + d("r1", "r2")), asc=False)
    diam = spark.range(1).select(F.lit(float(2 * (n.bit_length() - 1))).alias("diameter"))
    return _delta_summary(q.select(((s[0] - s[1]) / 2.0).alias("raw")), diam)


def _delta_summary(raw: DataFrame, diam: DataFrame) -> DataFrame:
    d = cut_lineage(raw.crossJoin(F.broadcast(diam)).select("diameter", (F.col("raw") / F.col("diameter")).alias("delta")))  # one-row diameter
    q = ranking.quantiles(d, "delta", [0.5, 0.95], names=["median", "p95"])
    return d.agg(F.max("diameter").alias("diameter"), F.avg("delta").alias("mean")).crossJoin(F.broadcast(q))


# ---- curvature ----------------------------------------------------------------------------------------------

def triangles(undirected: DataFrame) -> DataFrame:
    """Every triangle once as (a, b, c). Edges point from lower to higher degree, so no vertex fans out into more
    than about the square root of twice the edge count, hub or not."""
    deg = undirected.groupBy("u").agg(F.count(F.lit(1)).alias("deg"))
    e = undirected.select("u", "v").join(deg.withColumnRenamed("deg", "du"), "u").join(deg.select(F.col("u").alias("v"), F.col("deg").alias("dv")), "v")
    up = F.struct("du", "u") < F.struct("dv", "v")
    o = e.where(up).select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct(F.col("dv"), F.col("v")).alias("key"))
    x = o.select("a", "b", F.col("key").alias("kb"))
    y = o.select("a", F.col("b").alias("c"), F.col("key").alias("kc"))
    wedges = x.join(y, "a").where(F.col("kb") < F.col("kc")).select("a", "b", "c")
    return wedges.join(o.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).select("a", "b", "c")


def forman(undirected: DataFrame) -> DataFrame:
    """4 - deg u - deg v + 3 x triangles on every directed edge of a symmetric edge table."""
    tri = triangles(undirected)
    sides = F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p in "abc" for q in "abc" if p != q])
    per_edge = tri.select(F.explode(sides).alias("e")).groupBy("e.u", "e.v").agg(F.count(F.lit(1)).alias("tri"))
    deg = undirected.groupBy("u").agg(F.count(F.lit(1)).alias("deg_u"))
    e = undirected.select("u", "v").join(deg, "u").join(deg.select(F.col("u").alias("v"), F.col("deg_u").alias("deg_v")), "v")
    e = e.join(per_edge, ["u", "v"], "left").withColumn("tri", F.coalesce("tri", F.lit(0)))
    return e.select("u", "v", "tri", (4 - F.col("deg_u") - F.col("deg_v") + 3 * F.col("tri")).alias("curvature"))


def curvature_summary(edges: DataFrame, value: str = "curvature") -> DataFrame:
    q = ranking.quantiles(edges, value, [0.05, 0.5, 0.95], names=["p5", "p50", "p95"])
    basic = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.avg((F.col(value) < 0).cast("double")).alias("share_negative"), F.avg(value).alias("mean"))
    return basic.crossJoin(F.broadcast(q))  # one row each


def _transport(cost: np.ndarray, mu: np.ndarray, nu: np.ndarray) -> np.ndarray:
    """Exact transport costs of a batch of small problems: cheapest paths from rows with mass left to columns with room, one per
    problem and step, all problems side by side. Costs are not negative; masses of a problem are equal in sum."""
    tiny, out_of = 1e-12, np.inf
    n, a, c = cost.shape
    flow, left, room = np.zeros_like(cost), mu.astype(float).copy(), nu.astype(float).copy()
    slack = tiny * np.maximum(1.0, cost.max(initial=0.0))
    while True:
        act = np.flatnonzero((left.max(1, initial=0.0) > tiny) & (room.max(1, initial=0.0) > tiny))
        if not len(act):
            return (flow * cost).sum((1, 2))
        w, moved, each = cost[act], flow[act] > tiny, np.arange(len(act))
        du, dv = np.where(left[act] > tiny, 0.0, out_of), np.full((len(act), c), out_of)
        pu, pv = np.full((len(act), a), -1), np.zeros((len(act), c), int)
        for _ in range(a + c):
            to = du[:, :, None] + w
            by = to.argmin(1)
            reach = np.take_along_axis(to, by[:, None, :], 1)[:, 0]
            better = reach < dv - slack
            dv, pv = np.where(better, reach, dv), np.where(better, by, pv)
            back = np.where(moved, dv[:, None, :] - w, out_of)
            by = back.argmin(2)
            reach = np.take_along_axis(back, by[:, :, None], 2)[:, :, 0]
            better = reach < du - slack
            du, pu = np.where(better, reach, du), np.where(better, by, pu)
            if not better.any():
                break
        end = np.where(room[act] > tiny, dv, out_of).argmin(1)
        amount, path = room[act, end], []
        at, going = end.copy(), np.ones(len(act), bool)
        for _ in range(a + c):
            i = pv[each, at]
            prior = pu[each, i]
            path.append((i, at.copy(), prior, going.copy()))
            root = going & (prior < 0)
            amount = np.where(root, np.minimum(amount, left[act, i]), amount)
            going = going & (prior >= 0)
            if not going.any():
                break
            amount = np.where(going, np.minimum(amount, flow[act, i, np.maximum(prior, 0)]), amount)
            at = np.where(going, prior, at)
        room[act, end] -= amount
        for i, j, prior, on in path:
            np.add.at(flow, (act[on], i[on], j[on]), amount[on])
            first, later = on & (prior < 0), on & (prior >= 0)
            left[act[first], i[first]] -= amount[first]
            flow[act[later], i[later], prior[later]] -= amount[later]


def ollivier(edges: DataFrame, nodes: DataFrame, id_col: str, vec: str, lazy: float = 0.5, ks: Sequence[int] | None = None) -> DataFrame:
    """Ollivier curvature 1 - W1 / d per directed neighbour edge with lazy neighbour measures: (u, v, curvature).

    With ``ks`` it is (k, u, v, curvature), for each k the curvature on the graph of the edges of rank k or less; a smaller
    neighbourhood is the beginning of the largest, so the vectors are joined once for all.

    Each edge row carries the vectors of both neighbourhoods (k + 1 rows each) through two joins; batches of
    edges are solved together, and exactly: see :func:`_transport`.
    """
    vec_t = nodes.select(F.col(id_col).cast("long").alias("dst"), vectors.as_double(vec).alias("_v"))
    around = edges.select("src", "dst", "rank").join(vec_t, "dst").groupBy("src").agg(
        F.sort_array(F.collect_list(F.struct("rank", "_v"))).alias("_n")  # k rows per node
    )
    own = vec_t.select(F.col("dst").alias("node"), F.col("_v"))
    hood = around.join(own, F.col("src") == F.col("node")).select("node", F.flatten(F.concat(F.array("_v"), F.transform("_n", lambda t: t["_v"]))).alias("h"), (F.size("_n") + 1).alias("m"))
    # Transport costs the same both ways, so two nodes that are each other's neighbours are one row.
    forth, back = F.col("src") <= F.col("dst"), F.col("src") > F.col("dst")
    e = edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(
        *[F.max(F.when(way, F.col(c))).alias(f"{c}_{name}") for name, way in (("uv", forth), ("vu", back)) for c in ("rank", "dist")]
    )
    rows = e.join(hood.select(F.col("node").alias("u"), F.col("h").alias("hu"), F.col("m").alias("mu")), "u").join(
        hood.select(F.col("node").alias("v"), F.col("h").alias("hv"), F.col("m").alias("mv")), "v"
    )

    def solve(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            mu, mv = kernels.column(b, "mu"), kernels.column(b, "mv")
            rank = {way: kernels.numbers(b, f"rank_{way}") for way in ("uv", "vu")}
            least = np.fmin(rank["uv"], rank["vu"])
            out = {k: np.full(b.num_rows, np.nan) for k in ks or [None]}
            hu, hv = b.column("hu"), b.column("hv")
            for a, c in sorted(set(zip(mu.tolist(), mv.tolist()))):
                idx = np.nonzero((mu == a) & (mv == c))[0]
                for s in range(0, len(idx), 1024):
                    part = idx[s : s + 1024]
                    x = kernels.matrix(hu.take(pa.array(part))).reshape(len(part), a, -1)
                    y = kernels.matrix(hv.take(pa.array(part))).reshape(len(part), c, -1)
                    cost = np.sqrt(np.maximum((x**2).sum(2)[:, :, None] + (y**2).sum(2)[:, None, :] - 2 * x @ y.transpose(0, 2, 1), 0.0))
                    for k in out:
                        mine = np.flatnonzero(least[part] <= k) if k else np.arange(len(part))
                        m, n = (min(a, k + 1), min(c, k + 1)) if k else (a, c)
                        wa = np.r_[lazy, np.full(m - 1, (1 - lazy) / (m - 1))]
                        wb = np.r_[lazy, np.full(n - 1, (1 - lazy) / (n - 1))]
                        out[k][part[mine]] = _transport(cost[mine, :m, :n], np.tile(wa, (len(mine), 1)), np.tile(wb, (len(mine), 1)))
            for k, w in out.items():
                for way, names in (("uv", ["u", "v"]), ("vu", ["v", "u"])):
                    mine = np.flatnonzero(rank[way] <= (k or np.inf))
                    ends = [b.column(n).take(pa.array(mine)) for n in names]
                    curved = pa.array((1.0 - w / kernels.numbers(b, f"dist_{way}"))[mine])
                    size = {"k": pa.array(np.full(len(mine), k, np.int32))} if k else {}
                    yield pa.RecordBatch.from_pydict({**size, "u": ends[0], "v": ends[1], "curvature": curved})

    return rows.select(*e.columns, "hu", "mu", "hv", "mv").mapInArrow(solve, ("k int, " if ks else "") + "u long, v long, curvature double")


# ---- components, forests, paths -----------------------------------------------------------------------------

def components(edges: DataFrame, nodes: DataFrame | None = None, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) with the smallest node of each component as its name.

    Rounds of random contraction: every vertex points at the neighbour (or itself) with the least hash of the round,
    pointers are doubled once, and edges are renamed. Hashes make the number of rounds logarithmic whatever the order of the
    ids; the smallest node of each component is looked up once at the end. Each step is a combinable minimum or a
    join against one row per vertex, and a round's tables are deleted when the next one is stored.
    """
    both = edges.select(F.col(u).alias("a"), F.col(v).alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    all_nodes = both.select(F.col("a").alias("node"))
    if nodes is not None:
        all_nodes = all_nodes.unionByName(nodes.select(F.col(nodes.columns[0]).alias("node")))
    label = cut_lineage(all_nodes.where(F.col("node").isNotNull()).distinct().withColumn("centre", F.col("node")))
    live = cut_lineage(both.where(F.col("a") != F.col("b")).distinct())
    turn = 0
    while not live.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        hook = live.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least(order("a"), F.col("m"))["id"].alias("p"))
        hook = cut_lineage(hook)
        jump = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        move = cut_lineage(hook.join(jump, "p").select("a", F.col("pp").alias("to")))
        renamed = cut_lineage(
            live.join(move, "a").select(F.col("to").alias("a2"), F.col("b").alias("a"))
            .join(move, "a").select(F.col("a2").alias("a"), F.col("to").alias("b")).where(F.col("a") != F.col("b")).distinct()
        )
        moved = label.join(move.withColumnRenamed("a", "centre"), "centre", "left").select("node", F.coalesce("to", "centre").alias("centre"))
        moved = cut_lineage(moved)
        discard(live, hook, move, label)
        live, label = renamed, moved
    names = label.groupBy("centre").agg(F.min("node").alias("component"))
    return cut_lineage(label.join(names, "centre").select("node", "component"))


def spanning_forest(undirected: DataFrame) -> DataFrame:
    """Minimum spanning forest (u, v, w) of a symmetric edge table by Boruvka rounds, ties by edge ends."""
    live = undirected.where(F.col("u") != F.col("v")).select(
        F.col("u").alias("a"), F.col("v").alias("b"), "w", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")
    )
    live = cut_lineage(live)
    forest = None
    while not live.isEmpty():
        best = cut_lineage(
            live.groupBy("a").agg(F.min(F.struct("w", "lo", "hi", "b")).alias("e")).select("a", F.col("e.b").alias("p"), "e.w", "e.lo", "e.hi")
        )
        picked = best.select(F.col("lo").alias("u"), F.col("hi").alias("v"), "w").distinct()
        before, forest = forest, cut_lineage(picked if forest is None else forest.unionByName(picked).distinct())
        if before is not None:
            discard(before)
        # Two ends that chose each other form the only kind of cycle; the smaller becomes the root.
        back = best.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        ptr = best.select("a", "p").join(back, "p").select("a", F.when((F.col("pp") == F.col("a")) & (F.col("a") < F.col("p")), F.col("a")).otherwise(F.col("p")).alias("p"))
        ptr = cut_lineage(ptr)
        jumps = ptr
        while True:
            up = ptr.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            nxt = cut_lineage(ptr.join(up, "p").select("a", F.col("pp").alias("q"), F.col("p").alias("old")))
            discard(jumps)
            jumps = nxt
            moved = nxt.where(F.col("q") != F.col("old")).isEmpty()
            ptr = nxt.select("a", F.col("q").alias("p"))
            if moved:
                break
        old = live
        live = (
            live.join(ptr, "a").withColumnRenamed("p", "a2").drop("a").withColumnRenamed("b", "a").join(ptr, "a")
            .select(F.col("a2").alias("a"), F.col("p").alias("b"), "w", "lo", "hi").where(F.col("a") != F.col("b"))
        )
        # Between two components only the lightest edge can ever be chosen.
        live = live.groupBy("a", "b").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("a", "b", "e.w", "e.lo", "e.hi")
        live = cut_lineage(live)
        discard(old, best, jumps)
    if forest is None:
        return undirected.select("u", "v", "w").limit(0)
    return forest


def cut_sizes(forest: DataFrame, nodes: DataFrame, cuts: Sequence[int], top: int = 4) -> DataFrame:
    """Largest component sizes after removing the t longest forest edges, for each t in ``cuts``."""
    spark = forest.sparkSession
    t_max = max(cuts)
    longest = forest.orderBy(F.col("w").desc(), "u", "v").limit(t_max).collect()  # a handful of edges
    gone = spark.createDataFrame([(r["u"], r["v"]) for r in longest], "u long, v long") if longest else None
    kept = forest.join(F.broadcast(gone), ["u", "v"], "left_anti") if gone is not None else forest
    label = components(kept, nodes)
    ends = sorted({r["u"] for r in longest} | {r["v"] for r in longest})
    end_label = {r["node"]: r["component"] for r in label.where(F.col("node").isin(ends)).collect()}
    sizes = cut_lineage(label.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    out = None
    for t in cuts:
        merge: dict = {}

        def root(x):
            while x in merge:
                x = merge[x]
            return x

        for r in longest[t:]:
            a, b = root(end_label[r["u"]]), root(end_label[r["v"]])
            if a != b:
                merge[max(a, b)] = min(a, b)
        name = F.col("component")
        for src in merge:
            name = F.when(F.col("component") == src, F.lit(root(src))).otherwise(name)
        part = sizes.groupBy(name.alias("component")).agg(F.sum("n").alias("size")).orderBy(F.col("size").desc(), "component").limit(top)
        part = part.select(F.lit(t).alias("cut"), "size")
        out = part if out is None else out.unionByName(part)
    return out


def geodesics(undirected: DataFrame, landmarks: DataFrame, power: int = 1, require_connected: bool = True) -> DataFrame:
    """Shortest path lengths (landmark, node, d) from a set of landmarks, edge lengths raised to ``power``.

    Min-plus relaxation: only distances that improved in the last round are extended, and each round is one join
    and one combinable minimum.
    """
    e = cut_lineage(undirected.select("u", "v", F.pow("w", power).alias("w")))
    best = cut_lineage(landmarks.select(F.col(landmarks.columns[0]).alias("landmark")).withColumn("node", F.col("landmark")).withColumn("d", F.lit(0.0)))
    front, kept = best, best
    while not front.isEmpty():
        step = front.join(e, front["node"] == e["u"]).select("landmark", F.col("v").alias("node"), (F.col("d") + F.col("w")).alias("d"))
        step = step.groupBy("landmark", "node").agg(F.min("d").alias("nd"))
        merged = best.join(step, ["landmark", "node"], "full").select("landmark", "node", F.least("d", "nd").alias("d"), (F.col("d").isNull() | (F.col("nd") < F.col("d"))).alias("new"))
        merged = cut_lineage(merged)
        discard(kept)
        kept = merged
        best = merged.select("landmark", "node", "d")
        front = merged.where(F.coalesce("new", F.lit(False))).select("landmark", "node", "d")
    discard(e)
    if require_connected:
        want = landmarks.count() * undirected.select("u").distinct().count()
        if best.count() != want:
            raise ValueError("the graph is disconnected")
    return best


def class_purity(edges: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """Per class of confident sources (label >= 0): the mean over sources of the share of their confident
    neighbours that carry the same class."""
    l = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).alias("_l")).where(F.col("_l") >= 0)
    e = edges.join(l.select(F.col("_id").alias("dst"), F.col("_l").alias("ld")), "dst").select("src", "ld")
    src = l.select(F.col("_id").alias("src"), F.col("_l").alias("ls"))
    per = src.join(e, "src", "left").groupBy("src", "ls").agg(F.count("ld").alias("m"), F.avg((F.col("ls") == F.col("ld")).cast("double")).alias("p"))
    return per.groupBy(F.col("ls").alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.count("p").alias("n_with_neighbour"), F.avg("m").alias("mean_neighbours"), F.avg("p").alias("purity")
    )


def neighbour_tracking(edges_a: DataFrame, edges_b: DataFrame, attrs: DataFrame, id_col: str, attr: str, min_neighbours: int = 5) -> DataFrame:
    """Two neighbour spaces: per query the mean attribute distance of its neighbours in each, win share and sign test."""
    from quillon.functions.special import sign_test_pvalue

    a = attrs.select(F.col(id_col).cast("long").alias("_id"), F.col(attr).alias("_x")).where(F.col("_x").isNotNull())

    def mean_gap(edges, name):
        e = edges.join(a.select(F.col("_id").alias("src"), F.col("_x").alias("xs")), "src").join(a.select(F.col("_id").alias("dst"), F.col("_x").alias("xd")), "dst")
        g = e.groupBy("src").agg(F.avg(F.abs(F.col("xs") - F.col("xd"))).alias(name), F.count(F.lit(1)).alias("_n"))
        return g.where(F.col("_n") >= min_neighbours).drop("_n")

    j = mean_gap(edges_a, "gap_a").join(mean_gap(edges_b, "gap_b"), "src")
    out = j.agg(
        F.count(F.lit(1)).alias("n"), F.avg("gap_a").alias("mean_gap_a"), F.avg("gap_b").alias("mean_gap_b"),
        F.count_if(F.col("gap_b") < F.col("gap_a")).alias("wins_b"), F.avg(F.col("gap_b") - F.col("gap_a")).alias("mean_difference"),
    )
    return out.select("n", "mean_gap_a", "mean_gap_b", "mean_difference", "wins_b", (F.col("wins_b") / F.col("n")).alias("win_share"), sign_test_pvalue("wins_b", "n").alias("p_value"))
