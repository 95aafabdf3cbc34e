"""Queries for dictionary features and one-dimensional mixtures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import hashing, vectors
from quillon.operators import features as D, inference as R, knn, probes as L, ranking, vector_stats as V
from quillon.plans.registry import h32, query, uni
from quillon.plans.vectors_queries import Z, emb, zemb
from quillon.runtime import cut_lineage, table

ATOMS = 96
TOP = 8


def _r(df, digits, *cols):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def dictionary(spark, sf, seed=1, atoms=ATOMS):
    """A dictionary made of rows of the table: the ``atoms`` smallest hashes, one unit atom each."""
    d = ranking.sample_n(emb(spark, sf), "vec_id", atoms, seed)
    d = ranking.hash_order(d, "vec_id", seed, out="_r")
    return cut_lineage(d.select((F.col("_r") - 1).alias("feature"), vectors.normalise("v").alias("decoder")).withColumn("encoder", F.col("decoder")))


def dict_sql(seed=1, atoms=ATOMS) -> str:
    return f"""(select (row_number() over (order by {h32(seed, 'vec_id')}, vec_id) - 1)::INT as feature, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12)) as w
  from embeddings order by {h32(seed, 'vec_id')}, vec_id limit {atoms})"""


def acts_sql(seed=1) -> str:
    return f"""(select id, feature, value from (select e.vec_id as id, d.feature, list_inner_product(e.embedding::DOUBLE[], d.w) as value,
  row_number() over (partition by e.vec_id order by greatest(list_inner_product(e.embedding::DOUBLE[], d.w), 0) desc, d.feature) as r from embeddings e, {dict_sql(seed)} d) where r <= {TOP} and value > 0)"""


def acts(spark, sf, seed=1):
    return cut_lineage(D.sparse_encode(emb(spark, sf), "vec_id", "v", dictionary(spark, sf, seed), k=TOP))


@query("sparse_encode", f"select id, feature, round(value, 6) as value from {acts_sql()}")
def sparse_encode(spark, sf):
    return _r(acts(spark, sf), 6, "value")


@query("reconstruction_report", f"""
with a as (select * from {acts_sql()}), d as (select * from {dict_sql()}),
u as (select d.feature, generate_subscripts(w, 1) as i, unnest(w) as w from d), r as (select a.id, u.i, sum(a.value * u.w) as r from a join u using (feature) group by 1, 2),
x as (select vec_id as id, generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE as x from embeddings), m as (select i, avg(x) as m from x group by 1),
s as (select feature, sqrt(greatest(sum(value * value) / 500 - (sum(value) / 500) ** 2, 0)) as sd from a group by 1)
select round(sum((x.x - coalesce(r.r, 0)) ** 2) / sum((x.x - m.m) ** 2), 6) as fvu, round((select count(distinct feature) from a) / {ATOMS}.0, 6) as alive_share, (select count_if(sd > 1e-6) from s)::BIGINT as n_active
from x join m on m.i = x.i left join r on r.id = x.id and r.i = x.i""".replace("/ 500", "/ (select count(*) from embeddings)"))
def reconstruction_report(spark, sf):
    out = D.reconstruction_report(emb(spark, sf), "vec_id", "v", acts(spark, sf), dictionary(spark, sf))
    return _r(out, 6, "fvu", "alive_share")


def attributes(spark, sf):
    """Two label families per vector: class and centroid-like labels, and outside attributes by id."""
    e = emb(spark, sf)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("vec_id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    d = e.join(c, "vec_id", "left")
    return cut_lineage(d.select("vec_id", F.col("label").cast("double").alias("class"), F.when(F.col("label") != 3, F.col("v")[0].cast("double")).alias("axis"), "balance", "nation"))


LABELS = ["class", "axis", "balance", "nation"]
_ATTR = """(select v.vec_id as id, v.label::DOUBLE as class, case when v.label <> 3 then v.embedding[1]::DOUBLE end as axis, c.c_acctbal as balance, c.c_nationkey::DOUBLE as nation
  from embeddings v left join customer c on c.c_custkey = v.vec_id)"""


@query("feature_label_spearman", f"""
with a as (select * from {acts_sql()}), t as (select * from {_ATTR}), l as (select id, label, y from t unpivot (y for label in (class, axis, balance, nation))),
f as (select distinct feature from a), dense as (select f.feature, l.label, l.id, l.y, coalesce(a.value, 0.0) as v from l cross join f left join a on a.id = l.id and a.feature = f.feature),
r as (select feature, label, v, rank() over (partition by feature, label order by v) + (count(*) over (partition by feature, label, v) - 1) / 2.0::DOUBLE as rv,
  rank() over (partition by feature, label order by y) + (count(*) over (partition by feature, label, y) - 1) / 2.0::DOUBLE as ry from dense)
select feature, label, count(*)::BIGINT as n, count_if(v > 0)::BIGINT as nnz, round(corr(rv, ry), 6) as rho from r group by 1, 2 having count_if(v > 0) > 0""")
def feature_label_spearman(spark, sf):
    s = D.feature_label_spearman(acts(spark, sf), D.long_labels(attributes(spark, sf), "vec_id", LABELS))
    return _r(s, 6, "rho")


def _aligned(spark, sf):
    a = acts(spark, sf)
    att = attributes(spark, sf)
    s = cut_lineage(D.feature_label_spearman(a, D.long_labels(att, "vec_id", LABELS)))
    active = D.feature_moments(a, att.count()).where(F.col("std") > D.ACTIVE_STD)
    return a, att, s, cut_lineage(D.align_features(s, active, len(LABELS)))


@query("feature_alignment")
def feature_alignment(spark, sf):
    return _aligned(spark, sf)[3]


@query("feature_novelty")
def feature_novelty(spark, sf):
    return D.novelty(acts(spark, sf), attributes(spark, sf), "vec_id", ["class", "balance", "nation"])


@query("feature_family_census")
def feature_family_census(spark, sf):
    _, _, s, al = _aligned(spark, sf)
    fam = {"class": "content", "axis": "content", "balance": "outside", "nation": "outside"}
    return D.family_census(s, al, fam, q_cut=0.5)


@query("feature_recurrence", f"""
with a as (select * from {dict_sql(1)}), b as (select * from {dict_sql(2)})
select a.feature, round(max(abs(list_cosine_similarity(a.w, b.w))), 6) as best from a, b group by 1""")
def feature_recurrence(spark, sf):
    return _r(D.recurrence(dictionary(spark, sf, 1), dictionary(spark, sf, 2)), 6, "best")


@query("feature_recurrence_share", f"""
with a as (select * from {dict_sql(1)}), b as (select * from {dict_sql(2)}), m as (select a.feature, max(abs(list_cosine_similarity(a.w, b.w))) as best from a, b group by 1)
select count(*)::BIGINT as n, round(avg((best >= 0.6)::INT), 6) as share, round(quantile_cont(best, 0.5), 6) as median_best from m""")
def feature_recurrence_share(spark, sf):
    return _r(D.recurrence_share(D.recurrence(dictionary(spark, sf, 1), dictionary(spark, sf, 2))), 6, "share", "median_best")


@query("activation_match", f"""
with a as (select * from {acts_sql(1)}), b as (select * from {acts_sql(2)}), i as (select vec_id as id from embeddings),
fa as (select distinct feature from a), fb as (select distinct feature from b),
da as (select i.id, fa.feature, coalesce(a.value, 0.0) as v from i cross join fa left join a on a.id = i.id and a.feature = fa.feature),
db as (select i.id, fb.feature, coalesce(b.value, 0.0) as v from i cross join fb left join b on b.id = i.id and b.feature = fb.feature),
c as (select da.feature as fa, db.feature as fb, corr(da.v, db.v) as c from da join db using (id) group by 1, 2)
select fa as feature, round(max(abs(c)), 6) as best from c group by 1""")
def activation_match(spark, sf):
    return _r(D.activation_match(acts(spark, sf, 1), acts(spark, sf, 2), emb(spark, sf).count()), 6, "best")


@query("activation_match_shuffled")
def activation_match_shuffled(spark, sf):
    ids = emb(spark, sf).select("vec_id")
    b = cut_lineage(D.shuffle_rows(acts(spark, sf, 2), ids, 5))
    m = D.activation_match(acts(spark, sf, 1), b, ids.count())
    return m.agg(F.count(F.lit(1)).alias("n"), F.percentile("best", 0.5).alias("median_best"), F.avg((F.col("best") >= 0.3).cast("double")).alias("share_ge_0p3"))


TAU = 0.3


@query("dictionary_clusters", f"""
with recursive d as (select * from {dict_sql()}), s as (select a.feature as u, b.feature as v, list_cosine_similarity(a.w, b.w) as c, row_number() over (partition by a.feature order by list_cosine_similarity(a.w, b.w) desc, b.feature) as k from d a, d b where a.feature <> b.feature),
e as (select u, v from s where k <= 2 and c >= {TAU} union select v, u from s where k <= 2 and c >= {TAU}),
r as (select u as node, u as c from e union select e.v, r.c from r join e on e.u = r.node), l as (select node, min(c) as c from r group by 1)
select node::INT as feature, c::INT as cluster, count(*) over (partition by c)::BIGINT as members from l""")
def dictionary_clusters(spark, sf):
    return D.dictionary_clusters(dictionary(spark, sf), TAU)


@query("dictionary_tau_sweep")
def dictionary_tau_sweep(spark, sf):
    return D.tau_sweep(dictionary(spark, sf), [0.2, 0.3, 0.4])


def _cluster_scores(spark, sf):
    d = dictionary(spark, sf)
    c = cut_lineage(D.dictionary_clusters(d, TAU))
    return cut_lineage(D.cluster_components(acts(spark, sf), c, d))


@query("cluster_components")
def cluster_components(spark, sf):
    s = _cluster_scores(spark, sf)
    return s.select("cluster", F.posexplode("score").alias("component", "x")).groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("variance"), F.avg("x").alias("mean"))


def _pairs(spark, sf):
    z = zemb(spark, sf).select((F.col("label") % 2).alias("cluster"), F.col("vec_id").alias("id"), F.array(F.col("v")[0], F.col("v")[1]).alias("score"))
    return cut_lineage(D.normalised_pair(z))


_PAIR = f"""{Z}, p as (select label % 2 as cluster, vec_id as id, v[1] as x, v[2] as y from z),
st as (select cluster, avg(x) as mx, avg(y) as my, sqrt(2.0) / (sqrt(var_pop(x) + var_pop(y)) + 1e-12) as k from p group by 1),
n as (select p.cluster, id, (x - mx) * k as x, (y - my) * k as y from p join st using (cluster))"""


@query("cluster_separability", f"""
with {_PAIR}, r as (select cluster, a.range as a, x * cos(a.range * {math.pi / 1000!r}) + y * sin(a.range * {math.pi / 1000!r}) as u, y * cos(a.range * {math.pi / 1000!r}) - x * sin(a.range * {math.pi / 1000!r}) as v from n, range(1000) a),
h as (select cluster, a, least(greatest(trunc((u + 3) / 6 * 40), 0), 39)::INT as iu, least(greatest(trunc((v + 3) / 6 * 40), 0), 39)::INT as iv, count(*)::DOUBLE as n from r where abs(u) < 3 and abs(v) < 3 group by all),
w as (select *, sum(n) over (partition by cluster, a) as t, sum(n) over (partition by cluster, a, iu) as nu, sum(n) over (partition by cluster, a, iv) as nv from h),
m as (select cluster, a, sum(n / t * ln(n * t / (nu * nv))) as mi from w group by 1, 2)
select cluster::INT as cluster, round(min(mi) / ln(2.0), 6) as separability from m group by 1""")
def cluster_separability(spark, sf):
    return _r(D.separability(_pairs(spark, sf)), 6, "separability")


@query("cluster_mixture")
def cluster_mixture(spark, sf):
    return D.mixture_index(_pairs(spark, sf))


@query("cluster_plane_fit", f"""
with {_PAIR}, j as (select n.cluster, n.x, n.y, c.c_acctbal as t from n join customer c on c.c_custkey = n.id)
select cluster::INT as cluster, 'balance' as label, count(*)::BIGINT as n, round((var_pop(y) * covar_pop(x, t) ** 2 - 2 * covar_pop(x, y) * covar_pop(x, t) * covar_pop(y, t) + var_pop(x) * covar_pop(y, t) ** 2)
  / ((var_pop(x) * var_pop(y) - covar_pop(x, y) ** 2) * var_pop(t)), 6) as r2 from j group by 1""")
def cluster_plane_fit(spark, sf):
    return _r(D.plane_fit(_pairs(spark, sf), attributes(spark, sf), "vec_id", ["balance"], min_rows=50), 6, "r2")


@query("feature_angle_scan")
def feature_angle_scan(spark, sf):
    """Rank correlation of every feature with both coordinates of the doubled angle; the larger one is kept."""
    e = emb(spark, sf)
    th = F.atan2(F.col("v")[1].cast("double"), F.col("v")[0].cast("double"))
    lab = D.long_labels(e.select("vec_id", F.cos(th).alias("cos"), F.sin(th).alias("sin")), "vec_id", ["cos", "sin"])
    return D.feature_label_spearman(acts(spark, sf), lab).groupBy("feature").agg(F.max(F.abs("rho")).alias("loop_corr"))


@query("feature_ablation")
def feature_ablation(spark, sf):
    """Angle probe after removing the most angle-related features, against energy-matched random sets."""
    from quillon.plans.probes_queries import labelled

    d = labelled(spark, sf)
    dic = dictionary(spark, sf)
    a = cut_lineage(D.sparse_encode(d, "vec_id", "v", dic, k=TOP))
    test = L.is_test("vec_id")
    tr = d.where(~test)
    lab = D.long_labels(tr.select("vec_id", F.cos(2 * F.col("theta")).alias("cos"), F.sin(2 * F.col("theta")).alias("sin")), "vec_id", ["cos", "sin"])
    scan = cut_lineage(D.feature_label_spearman(a, lab).groupBy("feature").agg(F.max(F.abs("rho")).alias("c")))
    mom = cut_lineage(D.feature_moments(a, d.count()))

    def err(table_, name):
        fit = L.fit_circular(table_.where(~test), "v", "theta", 2, [100.0])
        return L.circular_summary(L.circular_readout(fit, table_.where(test), "v", "theta", 2), 2).select("med_err").withColumn("what", F.lit(name))

    out = err(d, "baseline")
    chosen = cut_lineage(scan.orderBy(F.col("c").desc(), "feature").limit(10).select("feature"))
    out = out.unionByName(err(cut_lineage(D.ablate(d, "vec_id", "v", a, chosen, dic)), "top_10"))
    ctrl = cut_lineage(D.matched_controls(mom, chosen, 2))
    for i in range(2):
        pick = ctrl.where(F.col("control") == i).select("feature")
        out = out.unionByName(err(cut_lineage(D.ablate(d, "vec_id", "v", a, pick, dic)), f"control_{i}"))
    return out


@query("matched_feature_controls")
def matched_feature_controls(spark, sf):
    a = acts(spark, sf)
    mom = cut_lineage(D.feature_moments(a, emb(spark, sf).count()))
    chosen = mom.orderBy(F.col("energy").desc(), "feature").limit(12).select("feature")
    return D.matched_controls(mom, cut_lineage(chosen), 3)


@query("mixture_cut")
def mixture_cut(spark, sf):
    """Two-component cut of a bimodal colour: log price per unit shifted for one return flag."""
    l = table(spark, sf, "lineitem").select((F.log10("l_extendedprice") + F.when(F.col("l_returnflag") == "R", 2.0).otherwise(0.0)).alias("x"))
    c = D.two_component_cut(l, "x")
    return spark.createDataFrame([tuple(float(c[k]) for k in ("low", "high", "share_low", "cut"))], "low double, high double, share_low double, cut double")
