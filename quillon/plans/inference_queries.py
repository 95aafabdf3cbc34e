"""Queries for resampling intervals, nulls and multiplicity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import hashing, special
from quillon.operators import inference as R, probes as L, ranking, vector_stats as V
from quillon.plans.registry import h32, query, uni
from quillon.plans.vectors_queries import zemb
from quillon.runtime import cut_lineage, table

B = 40


def pois(u: str) -> str:
    cases = " ".join(f"when {u} < {c!r}::DOUBLE then {i}" for i, c in enumerate(hashing.POISSON1_CDF))
    return f"(case {cases} else {len(hashing.POISSON1_CDF)} end)"


def _w(seed) -> str:
    return pois(uni(seed, "rep || ':' || o_orderkey"))


_REPS = f"r as (select o_orderstatus, o_totalprice as x, rep, {_w(9)} as w from orders, (select range as rep from range({B})))"


def _r(df, digits, *cols):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("bootstrap_ci_mean", f"""
with {_REPS}, s as (select o_orderstatus, rep, sum(w * x) / sum(w) as m, sum(w) / sum(w / x) as h from r group by 1, 2),
l as (select o_orderstatus, 'mean' as metric, m as v from s union all select o_orderstatus, 'harmonic', h from s)
select o_orderstatus, metric, count(*)::BIGINT as n_rep, round(quantile_cont(v, 0.025), 4) as ci_lo, round(quantile_cont(v, 0.975), 4) as ci_hi from l group by 1, 2""")
def bootstrap_ci_mean(spark, sf):
    o = table(spark, sf, "orders")
    x = F.col("o_totalprice")
    stats = {"mean": lambda total: total(x) / total(), "harmonic": lambda total: total() / total(1 / x)}
    return _r(R.intervals(R.bootstrap(o, "o_orderkey", stats, B, 9, ["o_orderstatus"]), ["mean", "harmonic"], ["o_orderstatus"]), 4, "ci_lo", "ci_hi")


@query("bootstrap_ci_slope", f"""
with r as (select o_custkey as z, o_totalprice as x, rep, {_w(10)} as w from orders, (select range as rep from range({B}))),
s as (select rep, (sum(w * z * x) - sum(w * z) * sum(w * x) / sum(w)) / (sum(w * z * z) - sum(w * z) ** 2 / sum(w)) as v from r group by 1)
select 'slope' as metric, count(*)::BIGINT as n_rep, round(quantile_cont(v, 0.025), 6) as ci_lo, round(quantile_cont(v, 0.975), 6) as ci_hi from s""")
def bootstrap_ci_slope(spark, sf):
    x, z = F.col("o_totalprice"), F.col("o_custkey").cast("double")
    slope = lambda total: (total(z * x) - total(z) * total(x) / total()) / (total(z * z) - F.pow(total(z), 2) / total())
    return _r(R.intervals(R.bootstrap(table(spark, sf, "orders"), "o_orderkey", {"slope": slope}, B, 10), ["slope"]), 6, "ci_lo", "ci_hi")


@query("bootstrap_ci_median", f"""
with {_REPS}, e as (select rep, x, unnest(range(w)) as copy from r), m as (select rep, quantile_cont(x, 0.5) as v from e group by 1)
select 'o_totalprice' as metric, count(*)::BIGINT as n_rep, round(quantile_cont(v, 0.025), 4) as ci_lo, round(quantile_cont(v, 0.975), 4) as ci_hi from m""")
def bootstrap_ci_median(spark, sf):
    reps = R.bootstrap_quantile(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", 0.5, B, 9)
    return _r(R.intervals(reps, ["o_totalprice"]), 4, "ci_lo", "ci_hi")


@query("basic_interval", f"""
with {_REPS}, s as (select rep, sum(w * x) / sum(w) as m from r group by 1), p as (select avg(o_totalprice) as p from orders)
select round(2 * p - quantile_cont(m, 0.975), 4) as basic_lo, round(2 * p - quantile_cont(m, 0.025), 4) as basic_hi from s, p group by p""")
def basic_interval(spark, sf):
    o = table(spark, sf, "orders")
    x = F.col("o_totalprice")
    ci = R.intervals(R.bootstrap(o, "o_orderkey", {"m": lambda total: total(x) / total()}, B, 9), ["m"])
    lo, hi = R.basic_interval(F.col("p"), F.col("ci_lo"), F.col("ci_hi"))
    return ci.crossJoin(F.broadcast(o.agg(F.avg("o_totalprice").alias("p")))).select(F.round(lo, 4).alias("basic_lo"), F.round(hi, 4).alias("basic_hi"))


@query("shuffle_null", f"""
with o as (select o_orderkey, case when o_orderstatus <> 'P' then o_totalprice end as x from orders),
a as (select o_orderkey, row_number() over (order by {h32('4a', 'o_orderkey')}, o_orderkey) as k from o where x is not null),
b as (select x, row_number() over (order by {h32('4b', 'o_orderkey')}, o_orderkey) as k from o where x is not null)
select o.o_orderkey, b.x as shuffled from o left join a on a.o_orderkey = o.o_orderkey left join b on b.k = a.k""")
def shuffle_null(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("x"))
    return R.shuffle_within(o, "o_orderkey", "x", 4, "shuffled").select("o_orderkey", "shuffled")


@query("shuffled_circular_probe")
def shuffled_circular_probe(spark, sf):
    """Circular probe on permuted angles: the error must sit at its chance floor."""
    from quillon.plans.probes_queries import labelled

    d = cut_lineage(R.shuffle_within(labelled(spark, sf), "vec_id", "theta", 0, "theta_shuffled"))
    return L.circular_probe(d, "vec_id", "v", "theta_shuffled", 2, n_boot=50)


@query("matched_norm_null")
def matched_norm_null(spark, sf):
    """Spread of the rows along random directions as long as a fitted one."""
    z = zemb(spark, sf).withColumn("y", F.col("label").cast("double"))
    w = L.fit_ridge(z, "v", ["y"], [100.0]).coef[:, 0]
    dirs = V.random_directions(50, len(w), 0, float(np.linalg.norm(w)))
    p = V.project(z, "v", np.column_stack([w, dirs]), "p").select(F.posexplode("p").alias("direction", "x"))
    return p.groupBy("direction").agg(F.stddev_pop("x").alias("spread"), F.avg("x").alias("mean"))


@query("sign_flip_null", f"""
with d as (select c_custkey, c_acctbal - 4500 as d from customer), r as (select rep, case when {h32(12, "rep || ':' || c_custkey")} % 2 = 0 then d else -d end as x from d, (select range as rep from range(30)))
select rep::INT as rep, round(quantile_cont(x, 0.5), 6) as median from r group by 1""")
def sign_flip_null(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") - 4500).alias("d"))
    return _r(R.sign_flip_null(d, "c_custkey", "d", 30, 12), 6, "median")


@query("sign_test", """
with c as (select c_mktsegment, count(*) as n, count_if(c_acctbal - 4400 > 0) as k from customer group by 1),
t as (select c_mktsegment, n, k, least(k, n - k) as tail from c),
p as (select c_mktsegment, any_value(n) as n, any_value(k) as k, sum(exp(lgamma(n + 1.0::DOUBLE) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0))) as s from (select t.*, unnest(range((tail + 1)::BIGINT)) as i from t) group by 1)
select c_mktsegment, n::BIGINT as n, k::BIGINT as n_positive, round(least(1.0, 2 * s), 6) as p_value from p""")
def sign_test(spark, sf):
    d = table(spark, sf, "customer").select("c_mktsegment", (F.col("c_acctbal") - 4400).alias("d"))
    return _r(R.sign_test(d, "d", ["c_mktsegment"]), 6, "p_value")


_P = f"select l_suppkey, l_returnflag, round(exp(-0.1 * abs(avg(round(l_discount * 100)) - 5) * sqrt(count(*))), 12) as p from lineitem group by 1, 2"


def _pvalues(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.groupBy("l_suppkey", "l_returnflag").agg(F.round(F.exp(-0.1 * F.abs(F.avg(F.round(F.col("l_discount") * 100)) - 5) * F.sqrt(F.count(F.lit(1)))), 12).alias("p"))


@query("bonferroni_bh", f"""
with p as ({_P}), f as (select l_suppkey, least(1.0, min(p) * 3) as p from p group by 1),
r as (select l_suppkey, p, p * count(*) over () / count(*) over (order by p range between unbounded preceding and current row) as x from f)
select l_suppkey, round(p, 8) as p_item, round(least(1.0, min(x) over (order by p desc range between unbounded preceding and current row)), 8) as q from r""")
def bonferroni_bh(spark, sf):
    f = cut_lineage(R.bonferroni(_pvalues(spark, sf), "l_suppkey", "p", 3))
    q = R.bh_qvalues(f, "p_item")
    return _r(f.join(q, "p_item").select("l_suppkey", "p_item", "q"), 8, "p_item", "q")


@query("bh_qvalues", f"""
with p as ({_P}), r as (select l_returnflag, p, p * count(*) over (partition by l_returnflag) / count(*) over (partition by l_returnflag order by p range between unbounded preceding and current row) as x from p)
select distinct l_returnflag, round(p, 8) as p, round(least(1.0, min(x) over (partition by l_returnflag order by p desc range between unbounded preceding and current row)), 8) as q from r""")
def bh_qvalues(spark, sf):
    return _r(R.bh_qvalues(cut_lineage(_pvalues(spark, sf)), "p", ["l_returnflag"]), 8, "p", "q")


@query("correlation_pvalues")
def correlation_pvalues(spark, sf):
    """Two-sided t tail of a correlation per group."""
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.corr("l_discount", "l_tax").alias("r"), F.count(F.lit(1)).alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return c.withColumn("p", special.t_pvalue(t, (F.col("n") - 2).cast("double")))


_KS = """
with c as (select event_type as g, (value * 7 % 180) / 180 as x from events), r as (select g, x, row_number() over (partition by g order by x) as i, count(*) over (partition by g) as n from c)
select g as event_type, any_value(n)::BIGINT as n, round(max(greatest(i / n::DOUBLE - x, x - (i - 1) / n::DOUBLE)), 8) as d from r group by 1"""


@query("ks_uniform", _KS)
def ks_uniform(spark, sf):
    return _r(_ks(spark, sf).select("event_type", "n", "d"), 8, "d")


def _ks(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.pmod(F.col("value") * 7, F.lit(180.0)) / 180).alias("x"))
    return R.ks_uniform(e, "x", ["event_type"])


@query("ks_pvalues")
def ks_pvalues(spark, sf):
    return _ks(spark, sf).withColumn("p", special.ks_pvalue("d", "n"))
