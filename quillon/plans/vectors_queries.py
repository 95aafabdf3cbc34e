"""Queries for vector statistics and nearest neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import hashing, vectors
from quillon.operators import knn, ranking, vector_stats as V
from quillon.plans.registry import h32, query, uni
from quillon.runtime import table

# z-scored vectors in SQL, shared by the checks below.
Z = """
u as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE as x from embeddings),
s as (select i, avg(x) as m, stddev_pop(x) as sd from u group by i),
z as (select vec_id, any_value(label) as label, list((x - m) / (sd + 1e-8) order by u.i) as v from u join s on s.i = u.i group by vec_id)"""
KNN = Z + """,
d as (select a.vec_id as src, b.vec_id as dst, list_distance(a.v, b.v) as dist from z a, z b where a.vec_id <> b.vec_id),
k as (select src, dst, dist, row_number() over (partition by src order by dist, dst) as rank from d)"""


def emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")


def zemb(spark, sf):
    e = emb(spark, sf)
    return V.zscore(e, "v")


def knn_graph(spark, sf, k):
    z = zemb(spark, sf)
    return knn.knn_join(z, z, k, "vec_id", "v")


@query("knn_topk", f"with {KNN} select src, dst, rank::INT as rank, round(dist, 6) as dist from k where rank <= 10")
def knn_topk(spark, sf):
    return knn_graph(spark, sf, 10).withColumn("dist", F.round("dist", 6))


@query("knn_cosine", """
with d as (select a.vec_id as src, b.vec_id as dst, list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) as dist from embeddings a, embeddings b where a.vec_id <> b.vec_id),
k as (select src, dst, dist, row_number() over (partition by src order by dist, dst) as rank from d)
select src, dst, rank::INT as rank, round(dist, 6) as dist from k where rank <= 5""")
def knn_cosine(spark, sf):
    e = emb(spark, sf)
    return knn.knn_join(e, e, 5, "vec_id", "v", metric="cosine").withColumn("dist", F.round("dist", 6))


@query("self_alignment", f"""
with p as (select vec_id, list_transform(embedding::DOUBLE[], lambda x, i: x + 0.05 * ({uni(31, "vec_id || ':' || i")} - 0.5)) as v from embeddings where {h32(30, 'vec_id')} % 5 = 0),
c as (select p.vec_id as a, e.vec_id as b, list_cosine_distance(p.v, e.embedding::DOUBLE[]) as d from p, embeddings e),
t as (select a, min((d, b)) as m from c group by 1)
select count(*)::BIGINT as n, round(avg((m[2] = a)::INT), 6) as self_share from t""")
def self_alignment(spark, sf):
    """A re-encoded fifth of the rows (small noise) looked up in the whole table."""
    e = emb(spark, sf)
    noisy = F.transform(vectors.as_double("v"), lambda x, i: x + 0.05 * (hashing.uniform(31, F.col("vec_id"), i + 1) - 0.5))
    probe = e.where(hashing.hash32(30, "vec_id") % 5 == 0).withColumn("v", noisy)
    return knn.self_match_share(probe, e, "vec_id", "v").withColumn("self_share", F.round("self_share", 6))


@query("dim_stats", """
with u as (select generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE as x from embeddings)
select (i - 1)::INT as dim, round(avg(x), 8) as mean, round(stddev_pop(x), 8) as std from u group by i""")
def dim_stats(spark, sf):
    return V.by_dimension(V.dim_stats(emb(spark, sf), "v")).select("dim", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


@query("dim_zscore_stats", f"""
with {Z} select vec_id, round(list_sum(v), 6) as z_sum, round(sqrt(list_inner_product(v, v)), 6) as z_norm from z""")
def dim_zscore_stats(spark, sf):
    z = zemb(spark, sf)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return z.select("vec_id", F.round(total, 6).alias("z_sum"), F.round(vectors.norm("v"), 6).alias("z_norm"))


@query("zscore_other_table", """
with a as (select vec_id, embedding from embeddings where label < 5),
s as (select i, avg(x) as m, stddev_pop(x) as sd from (select generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE as x from a) group by i),
b as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE as x from embeddings where label >= 5)
select vec_id, round(sqrt(sum(((x - m) / (sd + 1e-8)) ** 2)), 6) as z_norm from b join s on s.i = b.i group by 1""")
def zscore_other_table(spark, sf):
    e = emb(spark, sf)
    stats = V.dim_stats(e.where(F.col("label") < 5), "v")
    return V.zscore(e.where(F.col("label") >= 5), "v", stats).select("vec_id", F.round(vectors.norm("v"), 6).alias("z_norm"))


@query("vector_profile", """
with u as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE as x from embeddings),
n as (select vec_id, sqrt(sum(x * x)) as nrm, count(*) as d from u group by 1), s as (select i, stddev_pop(x) as sd from u group by 1)
select (select count(*) from n)::BIGINT as n_rows, (select max(d) from n)::INT as dims, (select count_if(isnan(x)) from u)::BIGINT as n_nan, (select count_if(isinf(x)) from u)::BIGINT as n_inf,
 (select round(avg(nrm), 6) from n) as norm_mean, (select round(stddev_pop(nrm), 6) from n) as norm_std, (select round(min(sd), 8) from s) as dim_std_min, (select round(max(sd), 8) from s) as dim_std_max,
 (select round(max(sd) / min(sd), 6) from s) as dim_std_ratio""")
def vector_profile(spark, sf):
    p = V.vector_profile(emb(spark, sf), "v")
    digits = {"norm_mean": 6, "norm_std": 6, "dim_std_min": 8, "dim_std_max": 8, "dim_std_ratio": 6}
    return p.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in p.columns])


@query("gram_matrix", """
with u as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE as x from embeddings)
select (a.i - 1)::INT as i, (b.i - 1)::INT as j, round(sum(a.x * b.x), 6) as value from u a join u b using (vec_id) group by a.i, b.i""")
def gram_matrix(spark, sf):
    return V.gram(emb(spark, sf), "v").withColumn("value", F.round("value", 6))


@query("class_centroids", """
with u as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE as x from embeddings)
select label, (i - 1)::INT as dim, round(avg(x), 8) as mean, round(stddev_pop(x), 8) as std from u group by label, i""")
def class_centroids(spark, sf):
    d = V.by_dimension(V.dim_stats(emb(spark, sf), "v", ["label"]), ["label"])
    return d.select("label", "dim", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


@query("centroid_direction_cosine", """
with u as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE as x from embeddings),
p as (select i, avg(x) filter (label >= 7) - avg(x) filter (label <= 2) as w from u group by i),
c as (select i, avg(x) filter (label = 9) - avg(x) filter (label = 7 or label = 8) as w from u group by i)
select round(sum(p.w * c.w) / sqrt(sum(p.w ** 2) * sum(c.w ** 2)), 6) as cosine from p join c using (i)""")
def centroid_direction_cosine(spark, sf):
    e = emb(spark, sf)
    lab = F.col("label")
    parent = V.mean_difference(e, lab >= 7, lab <= 2, "v").select(F.col("direction").alias("p"))
    child = V.mean_difference(e, lab == 9, lab.isin(7, 8), "v").select(F.col("direction").alias("c"))
    return parent.crossJoin(F.broadcast(child)).select(F.round(vectors.dot("p", "c"), 6).alias("cosine"))


_AB = """
with d as (select a.vec_id as a, b.vec_id as b, {dist} as d from embeddings a, embeddings b where a.vec_id < b.vec_id),
e as (select unnest([a, b]) as node, d from d), n as (select min(d) as nn from e group by node)
select count(*)::BIGINT as n_pairs, round((max(d) - min(d)) / min(d), 5) as relative_contrast, round((select avg(nn) from n) / avg(d), 6) as nn_over_mean,
  round(stddev_pop(d) / avg(d), 6) as distance_cv, round(quantile_cont(d, 0.95) / quantile_cont(d, 0.05), 6) as p95_over_p5 from d"""


def _rounded(df):
    d = {"relative_contrast": 5}
    return df.select(*[F.round(c, d.get(c, 6)).alias(c) if c != "n_pairs" else F.col(c) for c in df.columns])


@query("distance_concentration", _AB.replace("{dist}", "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"))
def distance_concentration(spark, sf):
    return _rounded(knn.distance_concentration(emb(spark, sf), "vec_id", "v"))


@query("distance_concentration_cosine", _AB.replace("{dist}", "list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"))
def distance_concentration_cosine(spark, sf):
    return _rounded(knn.distance_concentration(emb(spark, sf), "vec_id", "v", metric="cosine"))


@query("pca_variance")
def pca_variance(spark, sf):
    return V.Components(zemb(spark, sf), "v").table(spark)


@query("pca_scores_variance")
def pca_scores_variance(spark, sf):
    """Variance of the projected rows per component; equals the eigenvalue."""
    z = zemb(spark, sf)
    comp = V.Components(z, "v", 10)
    scores = comp.transform(z, "v", "pc").select(F.posexplode("pc").alias("component", "x"))
    return scores.groupBy("component").agg(F.var_samp("x").alias("variance"), F.avg("x").alias("mean"))


@query("participation_ratio", """
with u as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE as x from embeddings),
c as (select a.i, b.i as j, covar_samp(a.x, b.x) as c from u a join u b using (vec_id) group by a.i, b.i)
select round(sum(case when i = j then c end) ** 2 / sum(c * c), 6) as participation from c""")
def participation_ratio(spark, sf):
    """(trace C)^2 / trace(C^2), which needs no eigenvalues in SQL."""
    pr = V.Components(emb(spark, sf), "v").participation()
    return spark.createDataFrame([(pr,)], "participation double").select(F.round("participation", 6).alias("participation"))


@query("whitened_moments")
def whitened_moments(spark, sf):
    """Second moments after whitening: the identity up to the shrinkage."""
    z = zemb(spark, sf)
    w = V.whitening_matrix(z, "v")
    return V.gram(V.project(z, "v", w, "v"), "v")


def transformed(spark, sf, name: str):
    """Re-encoded versions of the vectors by formula: 'flip' negates odd dimensions slightly, 'sandwich' adds noise."""
    amp = {"sandwich": 0.02, "flip": 0.02, "twice": 0.03}[name]
    seed = {"sandwich": 61, "flip": 62, "twice": 63}[name]
    e = emb(spark, sf)
    extra = F.lit(0.03) if name == "flip" else F.lit(0.0)
    sgn = hashing.sign(64, F.col("vec_id"))
    moved = F.transform(
        vectors.as_double("v"),
        lambda x, i: x + amp * (hashing.uniform(seed, F.col("vec_id"), i + 1) - 0.5) + F.when(i < 8, sgn * extra).otherwise(0.0),
    )
    return e.withColumn("v", moved)


def tr_sql(name: str) -> str:
    amp = {"sandwich": 0.02, "flip": 0.02, "twice": 0.03}[name]
    seed = {"sandwich": 61, "flip": 62, "twice": 63}[name]
    extra = f" + case when i <= 8 then (case when {h32(64, 'vec_id')} % 2 = 0 then 0.03 else -0.03 end) else 0.0 end" if name == "flip" else ""
    return f"(select vec_id, label, list_transform(embedding::DOUBLE[], lambda x, i: x + {amp} * ({uni(seed, chr(118) + 'ec_id || ' + repr(':') + ' || i')} - 0.5){extra}) as v from embeddings)"


@query("paired_displacement", f"""
with d as (select a.vec_id, a.label, list_distance(a.v, b.v) as n from {tr_sql('sandwich')} a join {tr_sql('flip')} b using (vec_id))
select (label % 3)::INT as pool, count(*)::BIGINT as n, round(avg(n), 6) as mean, round(quantile_cont(n, 0.1), 6) as p10, round(quantile_cont(n, 0.5), 6) as median, round(quantile_cont(n, 0.9), 6) as p90 from d group by 1""")
def paired_displacement(spark, sf):
    d = V.paired_difference(transformed(spark, sf, "sandwich"), transformed(spark, sf, "flip"), "vec_id", "v").withColumn("pool", F.col("label") % 3)
    out = V.norm_summary(d, "diff", "pool")
    return out.select("pool", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p10", "median", "p90")])


@query("axis_structure")
def axis_structure(spark, sf):
    d = V.paired_difference(transformed(spark, sf, "sandwich"), transformed(spark, sf, "flip"), "vec_id", "v")
    return V.axis_structure(d, "diff")


@query("displacement_budget", f"""
with o as (select vec_id, label, embedding::DOUBLE[] as v from embeddings), f as (select * from {tr_sql('flip')}), s as (select * from {tr_sql('sandwich')}), t as (select * from {tr_sql('twice')}),
j as (select (o.label % 3)::INT as pool, list_distance(o.v, f.v) as spec, list_distance(s.v, f.v) as pure, list_distance(o.v, s.v) as resamp, list_distance(o.v, t.v) as twice
  from o join f using (vec_id) join s using (vec_id) join t using (vec_id)),
m as (select pool, quantile_cont(spec, 0.5) as spec, quantile_cont(pure, 0.5) as pure, quantile_cont(resamp, 0.5) as resamp, quantile_cont(twice, 0.5) as twice from j group by 1)
select pool, round(spec, 6) as spec, round(pure, 6) as pure, round(resamp, 6) as resamp, round(twice / resamp, 6) as twice_over_once, round(pure / (sqrt(2.0) * resamp), 6) as pure_over_prediction from m""")
def displacement_budget(spark, sf):
    """Median displacement by pool for three pairs of tables, and the independent-noise predictions."""
    from quillon.operators.displacement import displacement_budget as budget

    tables = {n: transformed(spark, sf, n) for n in ("flip", "sandwich", "twice")}
    base = emb(spark, sf).withColumn("pool", F.col("label") % 3)
    out = budget(base, tables, "vec_id", "v", "pool")
    return out.select("pool", *[F.round(c, 6).alias(c) for c in out.columns if c != "pool"])


@query("ring_scan")
def ring_scan(spark, sf):
    z = zemb(spark, sf).withColumn("theta", F.radians((F.col("label") * 18.0)))
    return V.ring_scan(z, "v", "theta", 2, 50)


@query("principal_angles")
def principal_angles(spark, sf):
    """Plane of two concept directions against planes of leading components, in degrees."""
    z = zemb(spark, sf)
    comp = V.Components(z, "v", 6)
    means = V.group_means(z.where(F.col("label") < 3), ["label"], "v").orderBy("label").collect()
    m = np.array([r["mean"] for r in means])
    plane = np.stack([m[1] - m[0], m[2] - m[0]], axis=1)
    rows = []
    for j in range(0, 6, 2):
        a = V.principal_angles(plane, comp.axes[:, j : j + 2])
        rows.append((j, float(a[0]), float(a[1])))
    null = [V.principal_angles(plane, V.random_directions(2, plane.shape[0], s))[0] for s in range(200)]
    rows.append((-1, float(np.percentile(null, 2.5)), float(np.percentile(null, 97.5))))
    return spark.createDataFrame(rows, "first_component int, angle_1 double, angle_2 double")


# Vectors with faults: every 17th is NULL, every 19th has a NaN, every 23rd a NULL component.
_FAULTS = "vec_id % 17 <> 0 and vec_id % 19 <> 0 and vec_id % 23 <> 0"


def faulty(spark, sf):
    parts = F.transform("v", lambda x, i: F.when((F.col("vec_id") % 19 == 0) & (i == 3), F.lit(float("nan"))).when((F.col("vec_id") % 23 == 0) & (i == 5), F.lit(None)).otherwise(x.cast("double")))
    return emb(spark, sf).withColumn("v", F.when(F.col("vec_id") % 17 == 0, F.lit(None)).otherwise(parts))


@query("knn_with_bad_vectors", f"""
with e as (select vec_id, embedding::DOUBLE[] as v from embeddings where {_FAULTS}),
d as (select a.vec_id as src, b.vec_id as dst, list_distance(a.v, b.v) as dist from e a, e b where a.vec_id <> b.vec_id),
k as (select *, row_number() over (partition by src order by dist, dst) as rank from d)
select src, dst, rank::INT as rank, round(dist, 6) as dist from k where rank <= 5""")
def knn_with_bad_vectors(spark, sf):
    """Faulty vectors take no part, as query or as neighbour."""
    e = faulty(spark, sf)
    return knn.knn_join(e, e, 5, "vec_id", "v").withColumn("dist", F.round("dist", 6))


@query("gram_with_null_vectors", f"""
with u as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE as x from embeddings where {_FAULTS})
select (a.i - 1)::INT as i, (b.i - 1)::INT as j, round(sum(a.x * b.x), 6) as value from u a join u b using (vec_id) group by a.i, b.i""")
def gram_with_null_vectors(spark, sf):
    return V.gram(faulty(spark, sf), "v").withColumn("value", F.round("value", 6))
