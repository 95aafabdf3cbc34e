"""Queries for restartable incremental work and for two-sample comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import hashing
from quillon.operators import inference as R, probes as L, sampling, shifts, vector_stats as V
from quillon.plans import bindings as B
from quillon.plans.joins_queries import _PART, _PLANAR, _PAIRS, counterparts
from quillon.plans.registry import h32, query, uni
from quillon.plans.vectors_queries import Z, emb, zemb
from quillon.runtime import cut_lineage, table
from quillon.sources.readers import scratch_path
from quillon.streaming import incremental


def _r(df, digits, *cols):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _arrivals(spark, sf):
    """Target positions as a folder of files, some rows repeated in a later file."""
    t = B.sky_positions(spark, sf, "customer", "c_custkey")
    src = scratch_path(spark, "arrivals")
    t.where(F.col("c_custkey") % 3 == 0).coalesce(1).write.parquet(f"{src}/part=0")
    t.where(F.col("c_custkey") % 3 <= 1).coalesce(1).write.parquet(f"{src}/part=1")
    return t, src


@query("incremental_match", _PAIRS + f""",
m as (select c_custkey, p_partkey, sep from (select *, row_number() over (partition by c_custkey order by sep, p_partkey) as k from p where sep <= 1.5) where k = 1)
select t.c_custkey, m.p_partkey, round(m.sep, 5) as sep from {B.sky_sql('customer', 'c_custkey')} t left join m using (c_custkey)""")
def incremental_match(spark, sf):
    """Two runs of the stream: the second sees one more file and must add only the rows it has not matched yet."""
    t, src = _arrivals(spark, sf)
    refs = cut_lineage(counterparts(spark, sf))
    out, cp = scratch_path(spark, "matched"), scratch_path(spark, "progress")
    incremental.incremental_match(spark, f"{src}/part=*", t.schema, refs, out, cp, "c_custkey", "p_partkey", 1.5)
    t.where(F.col("c_custkey") % 3 >= 1).coalesce(1).write.parquet(f"{src}/part=2")
    res = incremental.incremental_match(spark, f"{src}/part=*", t.schema, refs, out, cp, "c_custkey", "p_partkey", 1.5)
    return _r(res.select("c_custkey", "p_partkey", "sep"), 5, "sep")


@query("incremental_markers", _PLANAR + f""",
m as (select * from p where sep <= 1.6)
select t.c_custkey, m.p_partkey, round(m.sep, 5) as sep from {B.sky_sql('customer', 'c_custkey')} t left join m using (c_custkey) where t.c_custkey % 3 <= 1""")
def incremental_markers(spark, sf):
    """All counterparts of the arrived targets; a target without one keeps a marker row."""
    t, src = _arrivals(spark, sf)
    out, cp = scratch_path(spark, "matched"), scratch_path(spark, "progress")
    res = incremental.incremental_match(spark, f"{src}/part=*", t.schema, counterparts(spark, sf), out, cp, "c_custkey", "p_partkey", 1.6, keep_all=True)
    return _r(res.select("c_custkey", "p_partkey", "sep"), 5, "sep")


@query("continue_from_mark", "select event_id, value from events where event_id > 2499 order by event_id limit 1500")
def continue_from_mark(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    done = e.where(F.col("event_id") <= 2499)
    return incremental.continue_from(e, done, "event_id", 4000)


@query("marked_runs", """
select o_orderkey, o_orderpriority, o_totalprice from (select *, row_number() over (order by o_orderpriority, o_orderkey) as k from orders) where k <= (select count(*) // 2 from orders)""")
def marked_runs(spark, sf):
    """Three runs by a mark of five values: each cut falls among equal marks, and the runs together have lost none."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out, half = scratch_path(spark, "marked"), o.count() // 2
    for target in (half // 4, half // 2, half):
        done = incremental.run_marked(o, out, "o_orderpriority", "o_orderkey", target, lambda rows: rows)
    return done.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("chunk_resume", "select o_custkey % 8 as chunk, o_custkey, count(*)::BIGINT as n, round(sum(o_totalprice), 2) as total from orders group by 1, 2")
def chunk_resume(spark, sf):
    """Half of the chunks are finished by a first run; the second run processes the rest."""
    o = table(spark, sf, "orders").withColumn("chunk", F.col("o_custkey") % 8)
    path = scratch_path(spark, "chunks")
    work = lambda d: d.groupBy("chunk", "o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    incremental.run_chunks(o.where(F.col("chunk") < 4), "chunk", work, path, ["o_custkey"])
    return incremental.run_chunks(o, "chunk", work, path, ["o_custkey"]).withColumn("chunk", F.col("chunk").cast("long"))


# ---- two-sample comparison ----------------------------------------------------------------------------------

def samples(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "F"))
    return o.select("o_orderkey", "o_totalprice", "o_orderpriority", F.when(F.col("o_orderstatus") == "O", "a").otherwise("b").alias("sample"))


_S = "s as (select o_orderkey, o_totalprice as x, o_orderpriority as g, case when o_orderstatus = 'O' then 'a' else 'b' end as sample from orders where o_orderstatus in ('O', 'F'))"


@query("occupancy_ratio", f"""
with {_S}, w as (select *, 1 + x / 1000000 as wt, (x > 300000)::INT as i from s)
select round(sum(wt * i) filter (sample = 'a') / sum(wt) filter (sample = 'a') / (sum(wt * i) filter (sample = 'b') / sum(wt) filter (sample = 'b')), 6) as ratio,
  round((sum(wt) filter (sample = 'a')) ** 2 / sum(wt * wt) filter (sample = 'a'), 3) as ess from w""")
def occupancy_ratio(spark, sf):
    out = shifts.occupancy_ratio(samples(spark, sf), "o_orderkey", "sample", F.col("o_totalprice") > 300000, 1 + F.col("o_totalprice") / 1000000, 20)
    return out.select(F.round("ratio", 6).alias("ratio"), F.round("ess", 3).alias("ess"))


@query("balancing_weights", f"""
with {_S}, n as (select g, count_if(sample = 'a') as na, count_if(sample = 'b') as nb from s group by 1)
select s.o_orderkey, round(case when sample = 'a' then nb / na::DOUBLE else 1.0 end, 8) as weight from s join n using (g)""")
def balancing_weights(spark, sf):
    return shifts.balancing_weights(samples(spark, sf), "sample", ["o_orderpriority"]).select("o_orderkey", F.round("weight", 8).alias("weight"))


@query("rank_auc", f"""
with {_S}, r as (select sample, rank() over (order by round(x, -2)) + (count(*) over (partition by round(x, -2)) - 1) / 2.0::DOUBLE as r from s),
n as (select count_if(sample = 'a')::DOUBLE as p, count_if(sample = 'b')::DOUBLE as q, sum(r) filter (sample = 'a') as t from r)
select round((t - p * (p + 1) / 2) / (p * q), 8) as auc from n""")
def rank_auc(spark, sf):
    s = samples(spark, sf).withColumn("x", F.round("o_totalprice", -2))
    return _r(shifts.auc(s, "x", F.col("sample") == "a"), 8, "auc")


def _vector_samples(spark, sf):
    z = zemb(spark, sf)
    return z.withColumn("sample", F.when(F.col("label") < 5, "a").otherwise("b"))


@query("two_sample_auc")
def two_sample_auc(spark, sf):
    return shifts.two_sample_auc(_vector_samples(spark, sf), "vec_id", "v", "sample")


@query("conformal_pvalues", f"""
with c as (select round(o_totalprice, -3) as s from orders where o_orderstatus = 'F'), t as (select o_orderkey, round(o_totalprice, -3) as s from orders where o_orderstatus <> 'F'),
g as (select s, count(*) as k from c group by 1), r as (select s, sum(k) over (order by s desc) as ge from g), n as (select count(*) as n from c)
select t.o_orderkey, round((1 + coalesce(r.ge, 0)) / (n.n + 1.0::DOUBLE), 8) as p from n, t asof left join r on t.s <= r.s""")
def conformal_pvalues(spark, sf):
    o = table(spark, sf, "orders").withColumn("s", F.round("o_totalprice", -3))
    out = shifts.conformal_pvalues(o.where(F.col("o_orderstatus") != "F"), o.where(F.col("o_orderstatus") == "F"), "o_orderkey", "s")
    return out.select("o_orderkey", F.round("p", 8).alias("p"))


@query("planted_shift_recovery")
def planted_shift_recovery(spark, sf):
    """AUC between halves: untouched, with a planted mean shift, with a localised cluster and with inflated variance."""
    z = zemb(spark, sf)
    half = F.when(hashing.hash32("half", "vec_id") % 2 == 0, "a").otherwise("b")
    base = cut_lineage(z.withColumn("sample", half))
    d = V.random_directions(1, len(base.select("v").first()[0]), 0)[:, 0]
    a, b = base.where(F.col("sample") == "a"), base.where(F.col("sample") == "b")
    cases = {
        "none": a, "mean_shift": shifts.plant_shift(a, "vec_id", "v", d, 2.0).drop("planted"), "cluster": shifts.plant_shift(a, "vec_id", "v", d, 6.0, 0.02).drop("planted"),
        "scale": shifts.plant_scale(a, "v", d, 1.2), "deletion": shifts.plant_deletion(a, "vec_id", F.col("label") >= 5, 0.5),
    }
    out = None
    for name, moved in cases.items():
        both = cut_lineage(moved.select("vec_id", "v", "sample").unionByName(b.select("vec_id", "v", "sample")))
        one = shifts.two_sample_auc(both, "vec_id", "v", "sample", reg=0.1).withColumn("case", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("noise_by_stratum", f"""
with p as (select c_mktsegment as g, c_custkey, c_acctbal as v, row_number() over (partition by c_mktsegment order by {h32('3p', 'c_custkey')}, c_custkey) as r from customer), n as (select g, count(*) as n from p group by 1),
o as (select o_orderkey, c.c_mktsegment as g from orders join customer c on c.c_custkey = o_custkey)
select o.o_orderkey, p.v as noise from o join n using (g) join p on p.g = o.g and p.r = floor({uni(3, 'o.o_orderkey')} * n.n) + 1""")
def noise_by_stratum(spark, sf):
    """Each row draws a residual from its own stratum's pool."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("g"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(c.select("c_custkey", "g"), "c_custkey").select("o_orderkey", "g")
    return sampling.pool_draw(o, "o_orderkey", c, "c_custkey", "c_acctbal", "noise", 3, ["g"]).select("o_orderkey", "noise")


@query("standardised_difference", f"""
with {_S} select g as o_orderpriority, count_if(sample = 'a')::BIGINT as n_a, count_if(sample = 'b')::BIGINT as n_b,
  round((avg(x) filter (sample = 'a') - avg(x) filter (sample = 'b')) / sqrt((var_samp(x) filter (sample = 'a') + var_samp(x) filter (sample = 'b')) / 2), 6) as smd,
  abs((avg(x) filter (sample = 'a') - avg(x) filter (sample = 'b')) / sqrt((var_samp(x) filter (sample = 'a') + var_samp(x) filter (sample = 'b')) / 2)) < 0.05 as balanced from s group by 1""")
def standardised_difference(spark, sf):
    return _r(shifts.standardised_difference(samples(spark, sf), "sample", "o_totalprice", ["o_orderpriority"]), 6, "smd")


@query("nuisance_probes")
def nuisance_probes(spark, sf):
    from quillon.plans.probes_queries import labelled

    d = labelled(spark, sf).withColumns({"c1": F.col("v")[5], "c2": F.col("v")[6]})
    return shifts.nuisance_control(d, "vec_id", "v", "part", ["c1", "c2"], n_random=1, n_boot=20)


@query("decodability_table")
def decodability_table(spark, sf):
    from quillon.plans.probes_queries import labelled

    d = labelled(spark, sf)
    blank = d.withColumn("v", F.transform("v", lambda x, i: F.when(i < 8, F.lit(0.0)).otherwise(x)))
    return shifts.decodability_table(d, blank, "vec_id", "v", ["part", "y"], n_boot=20)


@query("calibrated_angle_null")
def calibrated_angle_null(spark, sf):
    from quillon.plans.probes_queries import labelled

    return shifts.angle_null(labelled(spark, sf), "v", ["y", "part", "third"], 200)


@query("relation_by_population", """
select o_orderstatus, count(*)::BIGINT as n, round(regr_slope(o_totalprice, o_custkey), 6) as slope, round(regr_intercept(o_totalprice, o_custkey), 3) as intercept, round(regr_r2(o_totalprice, o_custkey), 8) as r2
from orders group by 1 having count(*) >= 30""")
def relation_by_population(spark, sf):
    out = shifts.relation_by_population(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderstatus")
    return _r(_r(_r(out, 6, "slope"), 3, "intercept"), 8, "r2")


@query("relation_residual_probe")
def relation_residual_probe(spark, sf):
    from quillon.plans.probes_queries import labelled

    d = shifts.relation_residual(labelled(spark, sf), "third", "part", "residual")
    return L.probes(d, "vec_id", "v", ["part", "residual"], n_boot=50)


@query("mmd", f"""
with {Z}, k as (select a.label < 5 as sa, b.label < 5 as sb, exp(-(list_distance(a.v, b.v) ** 2) / (2 * 64.0)) as k from z a, z b where a.vec_id <> b.vec_id),
n as (select count_if(label < 5)::DOUBLE as na, count_if(label >= 5)::DOUBLE as nb from z)
select round(sum(k) filter (sa and sb) / any_value(na * (na - 1)) + sum(k) filter (not sa and not sb) / any_value(nb * (nb - 1)) - sum(k) filter (sa <> sb) / any_value(na * nb), 8) as mmd2 from k, n""")
def mmd(spark, sf):
    s = cut_lineage(_vector_samples(spark, sf))
    out = shifts.mmd(s.where(F.col("sample") == "a"), s.where(F.col("sample") == "b"), "vec_id", "v", 8.0)
    return _r(out, 8, "mmd2")
