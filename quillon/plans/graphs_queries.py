"""Queries for similarity graphs and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import vectors
from quillon.operators import descent, graph, knn, profiles, ranking, spectral, vector_stats as V
from quillon.plans.registry import h32, query, uni
from quillon.plans.vectors_queries import KNN, Z, emb, knn_graph, zemb
from quillon.runtime import cut_lineage, table


def _r(df, digits, *cols):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def edges(spark, sf, k):
    return cut_lineage(knn_graph(spark, sf, k))


_SYM = """,
e as (select src as u, dst as v, dist from k where rank <= 10 union all select dst, src, dist from k where rank <= 10),
g as (select u, v, max(dist) as w from e group by 1, 2)"""


@query("knn_descent")
def knn_descent(spark, sf):
    """Approximate neighbours of every z-scored vector, with the recall measured against exact neighbours of hashed rows."""
    z = cut_lineage(zemb(spark, sf))
    found = cut_lineage(descent.neighbour_descent(z, "vec_id", "v", 10))
    one = descent.audit(z, found, "vec_id", "v", 10)
    return _r(found.crossJoin(F.broadcast(one.select("recall"))), 6, "dist", "recall")  # one row


@query("symmetric_graph", f"with {KNN}{_SYM} select u, v, round(w, 6) as w from g")
def symmetric_graph(spark, sf):
    return _r(graph.symmetrise(edges(spark, sf, 10)), 6, "w")


@query("graph_degree", f"with {KNN}{_SYM} select u, count(*)::BIGINT as degree from g group by 1")
def graph_degree(spark, sf):
    return graph.symmetrise(edges(spark, sf, 10)).groupBy("u").agg(F.count(F.lit(1)).alias("degree"))


@query("knn_purity", f"""
with {KNN}, l as (select vec_id, case when label >= 5 then 1 when label <= 2 then 0 else -1 end as c from embeddings),
p as (select s.vec_id, s.c, count(case when t.c >= 0 then 1 end) as m, avg(case when t.c >= 0 then (s.c = t.c)::INT end) as p
  from l s left join k on k.src = s.vec_id and k.rank <= 20 left join l t on t.vec_id = k.dst where s.c >= 0 group by 1, 2)
select c::INT as class, count(*)::BIGINT as n, count(p)::BIGINT as n_with_neighbour, round(avg(m), 6) as mean_neighbours, round(avg(p), 6) as purity from p group by 1""")
def knn_purity(spark, sf):
    lab = emb(spark, sf).select("vec_id", F.when(F.col("label") >= 5, 1).when(F.col("label") <= 2, 0).otherwise(-1).alias("c"))
    return _r(graph.class_purity(knn_graph(spark, sf, 20), lab, "vec_id", "c"), 6, "mean_neighbours", "purity")


_MU = ", m as (select src, ln(max(case when rank = 2 then dist end) / max(case when rank = 1 then dist end)) as x from k where rank <= 2 group by 1)"


@query("twonn", f"""
with {KNN}{_MU}, c as (select x, (row_number() over (order by x) - 0.5::DOUBLE) / count(*) over () as f from m where x > 0),
b as (select sum(x * -ln(1 - f)) / sum(x * x) as linear from c where f < 0.9)
select count(*)::BIGINT as n, round(sum(x), 6) as sum_log, round((count(*) - 1) / sum(x), 6) as mle, round(any_value(b.linear), 6) as linear from m, b where x > 0""")
def twonn(spark, sf):
    return _r(graph.twonn(edges(spark, sf, 2)), 6, "sum_log", "mle", "linear")


@query("twonn_posterior")
def twonn_posterior(spark, sf):
    row = graph.twonn(edges(spark, sf, 2)).first()
    lo, hi = graph.twonn_posterior(row["n"], row["sum_log"])
    return spark.createDataFrame([(row["mle"], lo, hi)], "mle double, ci_lo double, ci_hi double")


@query("local_mle", f"""
with {KNN}, t as (select unnest([10, 14, 20, 28, 40]) as kk),
m as (select kk, src, (kk - 2) / sum(case when rank < kk then ln(dk.d / dist) end) as m from t join k on rank < kk join (select src as s2, rank as r2, dist as d from k) dk on dk.s2 = k.src and dk.r2 = kk group by 1, 2)
select kk::INT as k, count(*)::BIGINT as n, round(1 / avg(1 / m), 6) as dimension from m group by 1""")
def local_mle(spark, sf):
    return _r(graph.local_mle_pooled(knn_graph(spark, sf, 40), [10, 14, 20, 28, 40]), 6, "dimension")


_H = {s: sum(1.0 / j for j in range(s, 2 * s)) for s in (1, 2, 4, 8, 16, 24, 32)}


@query("gride", f"""
with {KNN}, h(scale, h) as (values {', '.join(f'({s}, {v!r}::DOUBLE)' for s, v in _H.items())}),
m as (select h.scale, h.h, ln(b.dist / a.dist) as x from h join k a on a.rank = h.scale join k b on b.src = a.src and b.rank = 2 * h.scale)
select scale::INT as scale, count(*)::BIGINT as n, round(max(h) / avg(x), 6) as dimension from m where x > 0 group by 1""")
def gride(spark, sf):
    return _r(graph.gride(knn_graph(spark, sf, 64), list(_H)), 6, "dimension")


@query("stratified_dimension", f"""
with {Z}, d as (select a.label < 5 as low, a.vec_id as src, b.vec_id as dst, list_distance(a.v, b.v) as dist from z a, z b where a.vec_id <> b.vec_id and (a.label < 5) = (b.label < 5)),
k as (select low, src, dist, row_number() over (partition by src order by dist, dst) as rank from d),
m as (select low, src, ln(max(case when rank = 2 then dist end) / max(case when rank = 1 then dist end)) as x from k where rank <= 2 group by 1, 2)
select low, count(*)::BIGINT as n, round((count(*) - 1) / sum(x), 6) as mle from m where x > 0 group by 1""")
def stratified_dimension(spark, sf):
    z = zemb(spark, sf).withColumn("low", F.col("label") < 5)
    e = cut_lineage(knn.knn_join(z, z, 2, "vec_id", "v", by=["low"]))
    return _r(graph.twonn(e, ["low"]).select("low", "n", "mle"), 6, "mle")


_QUADS, _DIAMETER_PAIRS = 1_000_000, 100_000


def _delta_sql(dist: str) -> str:
    pick = lambda seed, i: f"floor({uni(seed, i)} * n.n)::BIGINT"
    return f"""
with {Z}, r as (select v, row_number() over (order by {h32(0, 'vec_id')}, vec_id) - 1 as row from z), n as (select count(*) as n from z),
p as (select max({dist.replace('@1', 'a.v').replace('@2', 'b.v')}) as dm from (select {pick('0p-0', 'range')} as i, {pick('0p-1', 'range')} as j from range({_DIAMETER_PAIRS}), n) q join r a on a.row = q.i join r b on b.row = q.j),
q as (select {pick('0q-0', 'range')} as i, {pick('0q-1', 'range')} as j, {pick('0q-2', 'range')} as k, {pick('0q-3', 'range')} as l from range({_QUADS}), n),
ss as (select list_sort([{dist.replace('@1', 'a.v').replace('@2', 'b.v')} + {dist.replace('@1', 'c.v').replace('@2', 'd.v')}, {dist.replace('@1', 'a.v').replace('@2', 'c.v')} + {dist.replace('@1', 'b.v').replace('@2', 'd.v')},
  {dist.replace('@1', 'a.v').replace('@2', 'd.v')} + {dist.replace('@1', 'b.v').replace('@2', 'c.v')}], 'DESC') as s from q join r a on a.row = q.i join r b on b.row = q.j join r c on c.row = q.k join r d on d.row = q.l),
x as (select (s[1] - s[2]) / 2 / p.dm as delta, p.dm from ss, p)
select round(max(dm), 6) as diameter, round(avg(delta), 6) as mean, round(quantile_cont(delta, 0.5), 6) as median, round(quantile_cont(delta, 0.95), 6) as p95 from x"""


@query("delta_hyperbolicity", _delta_sql("list_distance(@1, @2)"))
def delta_hyperbolicity(spark, sf):
    return _r(graph.delta_hyperbolicity(zemb(spark, sf), "vec_id", "v", _QUADS, _DIAMETER_PAIRS), 6, "diameter", "mean", "median", "p95")


@query("delta_hyperbolicity_cosine", _delta_sql("list_cosine_distance(@1, @2)"))
def delta_hyperbolicity_cosine(spark, sf):
    return _r(graph.delta_hyperbolicity(zemb(spark, sf), "vec_id", "v", _QUADS, _DIAMETER_PAIRS, metric="cosine"), 6, "diameter", "mean", "median", "p95")


@query("delta_hyperbolicity_tree", "select (2 * floor(log2(count(*))))::DOUBLE as diameter, 0.0::DOUBLE as mean, 0.0::DOUBLE as median, 0.0::DOUBLE as p95 from orders")
def delta_hyperbolicity_tree(spark, sf):
    from quillon.runtime import table

    return graph.delta_hyperbolicity_tree(table(spark, sf, "orders"), "o_orderkey", _QUADS)


_FORMAN = f"""
with {KNN}{_SYM}, deg as (select u, count(*) as d from g group by 1),
t as (select g.u, g.v, count(b.v) as tri from g left join g a on a.u = g.u left join g b on b.u = a.v and b.v = g.v group by 1, 2),
f as (select t.u, t.v, t.tri, 4 - du.d - dv.d + 3 * t.tri as c from t join deg du on du.u = t.u join deg dv on dv.u = t.v)"""


@query("forman_edges", _FORMAN + " select u, v, tri::BIGINT as tri, c::BIGINT as curvature from f")
def forman_edges(spark, sf):
    return graph.forman(cut_lineage(graph.symmetrise(knn_graph(spark, sf, 10))))


@query("forman", _FORMAN + """ select count(*)::BIGINT as n_edges, round(avg((c < 0)::INT), 6) as share_negative, round(avg(c), 6) as mean, round(quantile_cont(c, 0.05), 6) as p5,
 round(quantile_cont(c, 0.5), 6) as p50, round(quantile_cont(c, 0.95), 6) as p95 from f""")
def forman(spark, sf):
    f = cut_lineage(graph.forman(cut_lineage(graph.symmetrise(knn_graph(spark, sf, 10)))))
    return _r(graph.curvature_summary(f), 6, "share_negative", "mean", "p5", "p50", "p95")


@query("ollivier")
def ollivier(spark, sf):
    """Curvature of the neighbour edges of all rows, transport solved exactly."""
    z = cut_lineage(zemb(spark, sf))
    return graph.curvature_summary(cut_lineage(graph.ollivier(edges(spark, sf, 10), z, "vec_id", "v")))


@query("ollivier_k_sweep")
def ollivier_k_sweep(spark, sf):
    """The same for three neighbourhood sizes, from one neighbour table."""
    z, e = cut_lineage(zemb(spark, sf)), edges(spark, sf, 15)
    curved = cut_lineage(graph.ollivier(e, z, "vec_id", "v", ks=(8, 10, 15)))
    out = None
    for k in (8, 10, 15):
        one = graph.curvature_summary(curved.where(F.col("k") == k)).select(F.lit(k).alias("k"), "*")
        out = one if out is None else out.union(one)
    return out


@query("components", f"""
with recursive {KNN}, e as (select src as u, dst as v from k where rank = 1 union select dst, src from k where rank = 1),
r as (select u as node, u as c from e union select e.v, r.c from r join e on e.u = r.node)
select node, min(c) as component from r group by 1""")
def components(spark, sf):
    return graph.components(edges(spark, sf, 1), u="src", v="dst")


@query("component_sizes", f"""
with recursive {KNN}, e as (select src as u, dst as v from k where rank <= 2 union select dst, src from k where rank <= 2),
r as (select u as node, u as c from e union select e.v, r.c from r join e on e.u = r.node), l as (select node, min(c) as c from r group by 1)
select c as component, count(*)::BIGINT as n from l group by 1""")
def component_sizes(spark, sf):
    return graph.components(edges(spark, sf, 2), u="src", v="dst").groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query("mst_edges")
def mst_edges(spark, sf):
    return graph.spanning_forest(cut_lineage(graph.symmetrise(knn_graph(spark, sf, 15))))


@query("mst_longest_gaps")
def mst_longest_gaps(spark, sf):
    f = graph.spanning_forest(cut_lineage(graph.symmetrise(knn_graph(spark, sf, 15))))
    return profiles.largest_gaps(f, "w", 8)


@query("mst_cut_sizes")
def mst_cut_sizes(spark, sf):
    f = cut_lineage(graph.spanning_forest(cut_lineage(graph.symmetrise(knn_graph(spark, sf, 10)))))
    return graph.cut_sizes(f, emb(spark, sf).select("vec_id"), [1, 2, 3])


@query("geodesics", f"""
with recursive {KNN}{_SYM.replace('rank <= 10', 'rank <= 15')}, lm as (select vec_id as landmark from embeddings order by {h32(5, 'vec_id')}, vec_id limit 3),
p as (select landmark, landmark as node, 0.0::DOUBLE as d, 0 as hop from lm
  union all select landmark, node, min(d), any_value(hop) from (select p.landmark, g.v as node, p.d + g.w as d, p.hop + 1 as hop from p join g on g.u = p.node where p.hop < 8) group by 1, 2),
b as (select landmark, node, min(d) as d from p group by 1, 2)
select landmark, node, round(d, 6) as d from b""")
def geodesics(spark, sf):
    lm = ranking.sample_n(emb(spark, sf).select("vec_id"), "vec_id", 3, 5)
    g = graph.symmetrise(edges(spark, sf, 15))
    return _r(graph.geodesics(g, lm, require_connected=False), 6, "d")


@query("fermat_geodesics", f"""
with recursive {KNN}{_SYM.replace('rank <= 10', 'rank <= 15')}, lm as (select vec_id as landmark from embeddings order by {h32(5, 'vec_id')}, vec_id limit 3),
p as (select landmark, landmark as node, 0.0::DOUBLE as d, 0 as hop from lm
  union all select landmark, node, min(d), any_value(hop) from (select p.landmark, g.v as node, p.d + g.w * g.w as d, p.hop + 1 as hop from p join g on g.u = p.node where p.hop < 12) group by 1, 2),
b as (select landmark, node, min(d) as d from p group by 1, 2)
select landmark, node, round(d, 6) as d from b""")
def fermat_geodesics(spark, sf):
    lm = ranking.sample_n(emb(spark, sf).select("vec_id"), "vec_id", 3, 5)
    return _r(graph.geodesics(graph.symmetrise(edges(spark, sf, 15)), lm, power=2, require_connected=False), 6, "d")


@query("diffusion_map")
def diffusion_map(spark, sf):
    pairs, _ = spectral.diffusion_map(edges(spark, sf, 32), 10)
    return spectral.spectrum_table(spark, pairs)


@query("diffusion_simple")
def diffusion_simple(spark, sf):
    """Median-bandwidth diffusion distances of the sample, summarised."""
    _, coords = spectral.diffusion_map(edges(spark, sf, 15), 10, kernel="median")
    return knn.distance_concentration(coords, "node", "coords")


@query("harmonic_test")
def harmonic_test(spark, sf):
    _, coords = spectral.diffusion_map(edges(spark, sf, 32), 8)
    return spectral.harmonic_r2(coords, "coords")


@query("diffusion_sensitivity")
def diffusion_sensitivity(spark, sf):
    return spectral.k_sensitivity(edges(spark, sf, 32), [16, 32], 6)


@query("neighbour_tracking")
def neighbour_tracking(spark, sf):
    """Raw-cosine neighbours against z-scored Euclidean neighbours: which follow the outside attribute better."""
    from quillon.runtime import table

    e = emb(spark, sf)
    attr = table(spark, sf, "customer").select(F.col("c_custkey").alias("vec_id"), F.col("c_acctbal").alias("x"))
    a = cut_lineage(knn.knn_join(e, e, 20, "vec_id", "v", metric="cosine"))
    return graph.neighbour_tracking(a, edges(spark, sf, 20), attr, "vec_id", "x")


@query("neighbour_tracking_means", f"""
with {KNN}, a as (select c_custkey as id, c_acctbal as x from customer),
g as (select k.src, avg(abs(s.x - t.x)) as gap from k join a s on s.id = k.src join a t on t.id = k.dst where rank <= 20 group by 1)
select count(*)::BIGINT as n, round(avg(gap), 6) as mean_gap_a from g""")
def neighbour_tracking_means(spark, sf):
    from quillon.runtime import table

    attr = table(spark, sf, "customer").select(F.col("c_custkey").alias("vec_id"), F.col("c_acctbal").alias("x"))
    e = edges(spark, sf, 20)
    return _r(graph.neighbour_tracking(e, e, attr, "vec_id", "x").select("n", "mean_gap_a"), 6, "mean_gap_a")


@query("translation_test")
def translation_test(spark, sf):
    from quillon.operators.sequences import translation_response

    z = zemb(spark, sf).withColumn("attr", F.col("label") / 10.0)
    return translation_response(z, "vec_id", "v", "attr", (0.0, 0.3), (0.7, 1.0), [-0.5, 0.0, 0.5, 1.0], k=20, n_random=2)


@query("sequence_path")
def sequence_path(spark, sf):
    from quillon.operators.sequences import sequence_path as path

    z = zemb(spark, sf)
    return path(z.withColumn("s", F.col("v")[0]), "v", "s")


@query("sequence_path_raw", """
with e as (select list(q) as e from (select unnest(quantile_cont(embedding[1]::DOUBLE, [0.0,0.2,0.4,0.6,0.8,1.0])) as q from embeddings)),
b as (select v.vec_id, v.embedding, case when embedding[1] >= e.e[5] then 4 when embedding[1] >= e.e[4] then 3 when embedding[1] >= e.e[3] then 2 when embedding[1] >= e.e[2] then 1 else 0 end as bin from embeddings v, e),
u as (select bin, generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE as x from b),
c as (select bin, i, avg(x) as m from u group by 1, 2), s as (select a.bin, sqrt(sum((a.m - b.m) ** 2)) as len from c a join c b on b.bin = a.bin + 1 and b.i = a.i group by 1),
h as (select sqrt(sum((a.m - b.m) ** 2)) as chord from c a join c b on a.i = b.i where a.bin = 0 and b.bin = 4)
select round((select sum(len) from s), 6) as path, round(chord, 6) as chord, round((select sum(len) from s) / chord, 6) as ratio from h""")
def sequence_path_raw(spark, sf):
    from quillon.operators.sequences import sequence_path as path

    e = emb(spark, sf)
    out = path(e.withColumn("s", F.col("v")[0].cast("double")), "v", "s", n_bins=5)
    return out.select(*[F.round(c, 6).alias(c) for c in ("path", "chord", "ratio")])


@query("spread_ratio", f"""
with {Z}, p as (select label, list_sum(v[1:8]) / sqrt(8.0) as p from z)
select round(stddev_pop(p) filter (label >= 5) / (stddev_pop(p) filter (label < 5) + 1e-9), 6) as ratio, round(stddev_pop(p) filter (label >= 5), 6) as std_in, round(stddev_pop(p) filter (label < 5), 6) as std_out from p""")
def spread_ratio(spark, sf):
    import numpy as np

    from quillon.operators.sequences import spread_ratio as spread

    w = np.zeros(64)
    w[:8] = 1 / np.sqrt(8.0)
    out = spread(zemb(spark, sf), "v", w, F.col("label") >= 5, F.col("label") < 5)
    return out.select(*[F.round(c, 6).alias(c) for c in ("ratio", "std_in", "std_out")])


@query("components_chain", """
with o as (select o_orderkey, o_orderkey // 1000 as block from orders)
select o_orderkey as node, min(o_orderkey) over (partition by block) as component from o""")
def components_chain(spark, sf):
    """Long ordered chains: every order is linked to the next key of its block of a thousand."""
    o = table(spark, sf, "orders").select("o_orderkey")
    nxt = o.select((F.col("o_orderkey") - 1).alias("u"), F.col("o_orderkey").alias("v"))
    links = o.join(nxt, F.col("o_orderkey") == F.col("u")).where(F.floor(F.col("u") / 1000) == F.floor(F.col("v") / 1000)).select("u", "v")
    return graph.components(links, o)
