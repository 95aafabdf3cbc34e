"""Queries for linear probes and concept directions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import angles, hashing, vectors
from quillon.operators import inference, probes as L, profiles, ranking, vector_stats as V
from quillon.plans.registry import h32, query
from quillon.plans.vectors_queries import Z, emb, transformed, zemb
from quillon.runtime import cut_lineage, table


def _r(df, digits, *cols):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def labelled(spark, sf):
    """z-scored vectors with a class label, an outside attribute by id, a partly missing label and an axis angle
    read from the first two raw dimensions."""
    z = zemb(spark, sf)
    raw = emb(spark, sf).select("vec_id", F.atan2(F.col("v")[1].cast("double"), F.col("v")[0].cast("double")).alias("full"), F.col("v")[2].cast("double").alias("third"))
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("vec_id"), F.col("c_acctbal").alias("balance"))
    out = z.join(raw, "vec_id").join(cust, "vec_id", "left")
    cols = {
        "y": F.col("label").cast("double"), "part": F.when(F.col("label") != 3, F.col("third") + F.col("v")[5] * 0.3),
        "theta": F.col("full") / 2, "pa": F.pmod(F.degrees("full") / 2, F.lit(180.0)), "stratum": F.when(F.col("label") < 5, "low").otherwise("high"),
    }
    return cut_lineage(out.withColumns(cols).drop("full"))


@query("ridge_probe")
def ridge_probe(spark, sf):
    return L.probe(labelled(spark, sf), "vec_id", "v", "part")


@query("ridge_probes_many")
def ridge_probes_many(spark, sf):
    return L.probes(labelled(spark, sf), "vec_id", "v", ["y", "part", "balance"])


_TRAIN = f"with {Z}"


@query("concept_direction")
def concept_direction(spark, sf):
    w = L.direction(labelled(spark, sf), "v", "part")
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "dim int, weight double")


@query("ridge_two_covariates", """
with m as (select avg(l_quantity) as mq, stddev_pop(l_quantity) + 1e-9 as sq, avg(l_discount) as md, stddev_pop(l_discount) + 1e-9 as sd, avg(l_extendedprice) as my, count(*) as n from lineitem),
s as (select sum((l_quantity - mq) * (l_quantity - mq)) / any_value(sq * sq) + 10 as a, sum((l_quantity - mq) * (l_discount - md)) / any_value(sq * sd) as b, sum((l_discount - md) ** 2) / any_value(sd * sd) + 10 as c,
  sum((l_quantity - mq) * (l_extendedprice - my)) / any_value(sq) as u, sum((l_discount - md) * (l_extendedprice - my)) / any_value(sd) as v from lineitem, m),
w as (select (c * u - b * v) / (a * c - b * b) as w1, (a * v - b * u) / (a * c - b * b) as w2 from s),
r as (select l_returnflag, l_extendedprice - (my + w1 * (l_quantity - mq) / sq + w2 * (l_discount - md) / sd) as res, l_extendedprice as y from lineitem, m, w)
select l_returnflag, count(*)::BIGINT as n, round(avg(res), 3) as mean_residual, round(stddev_pop(res), 3) as std_residual, round(1 - var_pop(res) / var_pop(y), 6) as r2 from r group by 1""")
def ridge_two_covariates(spark, sf):
    """Label residualised on two standardised covariates, ridge penalty 10."""
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_extendedprice")
    r = L.residualise(l, "l_extendedprice", ["l_quantity", "l_discount"], 10.0, "res")
    out = r.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("res").alias("mean_residual"), F.stddev_pop("res").alias("std_residual"),
        (1 - F.var_pop("res") / F.var_pop("l_extendedprice")).alias("r2"),
    )
    return _r(_r(out, 3, "mean_residual", "std_residual"), 6, "r2")


@query("residual_probe")
def residual_probe(spark, sf):
    """Probe of the label, and of its residual on covariates; the drop is what the covariates carried."""
    d = labelled(spark, sf).withColumns({"c1": F.col("v")[5], "c2": F.col("v")[6]})
    d = L.residualise(d, "part", ["c1", "c2"], 10.0, "res")
    return L.probes(d, "vec_id", "v", ["part", "res"])


@query("concept_angle")
def concept_angle(spark, sf):
    return L.concept_angle(labelled(spark, sf), "vec_id", "v", "y", "part", n_boot=100)


@query("angle_battery")
def angle_battery(spark, sf):
    return L.angle_battery(labelled(spark, sf), "v", ["y", "part", "third"])


@query("random_pair_angle", f"""
with {Z}, r as (select v, row_number() over (order by {h32(0, 'vec_id')}, vec_id) as r from z),
d as (select degrees(acos(least(greatest(list_cosine_similarity(a.v, b.v), -1.0), 1.0))) as d, len(a.v) as n from r a join r b on b.r = a.r + 1 and a.r % 2 = 1)
select max(n)::INT as dims, round(quantile_cont(d, 0.05), 6) as p5, round(quantile_cont(d, 0.5), 6) as median, round(quantile_cont(d, 0.95), 6) as p95 from d""")
def random_pair_angle(spark, sf):
    out = L.random_pair_angles(zemb(spark, sf), "vec_id", "v")
    return out.select("dims", *[F.round(c, 6).alias(c) for c in ("p5", "median", "p95")])


@query("circular_probe")
def circular_probe(spark, sf):
    return L.circular_probe(labelled(spark, sf), "vec_id", "v", "theta", 2)


@query("linear_angle_probe")
def linear_angle_probe(spark, sf):
    return L.linear_angle_probe(labelled(spark, sf), "vec_id", "v", "pa", 180.0)


def _fitted(d):
    return L.fit_circular(d.where(~L.is_test("vec_id")), "v", "theta", 2)


@query("fixed_probe_strata")
def fixed_probe_strata(spark, sf):
    d = labelled(spark, sf)
    held = L.circular_readout(_fitted(d), d.where(L.is_test("vec_id")), "v", "theta", 2)
    return L.circular_summary(held, 2, ["stratum"])


@query("stratum_refit")
def stratum_refit(spark, sf):
    return L.per_stratum_circular(labelled(spark, sf), "vec_id", "v", "theta", 2, "stratum", 10.0)


@query("modality_ablation")
def modality_ablation(spark, sf):
    """The same labels probed on the full vectors and on vectors with the first eight dimensions blanked."""
    d = labelled(spark, sf)
    blank = d.withColumn("v", F.transform("v", lambda x, i: F.when(i < 8, F.lit(0.0)).otherwise(x)))
    a = L.probes(d, "vec_id", "v", ["part", "third"], n_boot=50).select("label", F.col("r2").alias("r2_full"))
    b = L.probes(blank, "vec_id", "v", ["part", "third"], n_boot=50).select("label", F.col("r2").alias("r2_blank"))
    return a.join(b, "label").withColumn("drop", F.col("r2_full") - F.col("r2_blank"))


@query("component_sweep")
def component_sweep(spark, sf):
    return L.component_sweep(labelled(spark, sf), "vec_id", "v", "theta", 2, [2, 8, 16, 32, 64])


@query("split_sensitivity")
def split_sensitivity(spark, sf):
    d = labelled(spark, sf)
    out = None
    for s in range(10):
        test = L.is_test("vec_id", s)
        fit = L.fit_circular(d.where(~test), "v", "theta", 2, [100.0])
        one = L.circular_summary(L.circular_readout(fit, d.where(test), "v", "theta", 2), 2).withColumn("seed", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("med_err").alias("mean"), F.stddev_samp("med_err").alias("std"), F.min("med_err").alias("min"), F.max("med_err").alias("max"))


def _poly(spark, sf):
    l = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day"), F.col("o_custkey").cast("double").alias("cust"))
    lab = F.log10("o_totalprice") + F.col("day") / 400.0 + hashing.uniform(77, "o_orderkey") * 0.2
    return l.withColumns({"lp": F.log10("o_totalprice"), "label": F.when(F.col("o_orderkey") % 3 != 0, lab)})


@query("polynomial_ridge_report")
def polynomial_ridge_report(spark, sf):
    alphas = [10.0 ** (i / 2 - 3) for i in range(13)]
    return L.polynomial_ridge(_poly(spark, sf), "o_orderkey", ["lp", "day", "cust"], "label", alphas, apply=False)[0]


@query("polynomial_ridge_applied")
def polynomial_ridge_applied(spark, sf):
    alphas = [10.0 ** (i / 2 - 3) for i in range(13)]
    return L.polynomial_ridge(_poly(spark, sf), "o_orderkey", ["lp", "day", "cust"], "label", alphas)[1]


_RANKS = """
with r as (select l_returnflag as g, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0::DOUBLE as rx,
  rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE as ry from lineitem)"""


@query("spearman_by_group", _RANKS + " select g as l_returnflag, count(*)::BIGINT as n, round(corr(rx, ry), 6) as rho from r group by 1 having count(*) >= 30")
def spearman_by_group(spark, sf):
    return _r(L.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"], 30), 6, "rho")


@query("partial_spearman", """
with r as (select rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0::DOUBLE as rx,
  rank() over (order by o_custkey) + (count(*) over (partition by o_custkey) - 1) / 2.0::DOUBLE as ry, rank() over (order by dayofyear(o_orderdate)) + (count(*) over (partition by dayofyear(o_orderdate)) - 1) / 2.0::DOUBLE as rz from orders),
c as (select regr_slope(rx, rz) as sx, regr_intercept(rx, rz) as ix, regr_slope(ry, rz) as sy, regr_intercept(ry, rz) as iy from r),
e as (select round(rx - sx * rz - ix, 7) as ex, round(ry - sy * rz - iy, 7) as ey from r, c),
k as (select rank() over (order by ex) + (count(*) over (partition by ex) - 1) / 2.0::DOUBLE as a, rank() over (order by ey) + (count(*) over (partition by ey) - 1) / 2.0::DOUBLE as b from e)
select count(*)::BIGINT as n, round(corr(a, b), 6) as rho from k""")
def partial_spearman(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"), F.dayofyear("o_orderdate").alias("z"))
    return _r(L.partial_spearman(o, "x", "y", "z"), 6, "rho")


@query("contrast_null")
def contrast_null(spark, sf):
    d = labelled(spark, sf)
    lab = F.col("label")
    parent = V.mean_difference(d, lab >= 5, lab < 5, "v").first()["direction"]
    child = V.mean_difference(d, lab == 9, lab.between(5, 8), "v").first()["direction"]
    observed = abs(float(np.dot(parent, child)))
    n_child = d.where(lab == 9).count()
    null = L.contrast_null(d, "vec_id", "v", np.array(parent), lab >= 5, n_child, 100)
    return null.agg(F.lit(observed).alias("cosine"), F.percentile("cosine", 0.95).alias("null_p95"), F.count(F.lit(1)).alias("n_rep"))


@query("steering_response")
def steering_response(spark, sf):
    return L.steering_response(labelled(spark, sf), "v", "part", ["part", "y", "third"], 0.1)


def rotated(spark, sf, deg: float):
    """Vectors whose axis angle (first two raw dimensions, doubled) is turned by ``deg``."""
    c, s = float(np.cos(np.radians(2 * deg))), float(np.sin(np.radians(2 * deg)))
    e = emb(spark, sf)
    a, b = F.col("v")[0].cast("double"), F.col("v")[1].cast("double")
    turned = F.transform(vectors.as_double("v"), lambda x, i: F.when(i == 0, a * c - b * s).when(i == 1, a * s + b * c).otherwise(x))
    return V.zscore(e.withColumn("v", turned), "v", V.dim_stats(e, "v"))


@query("intervention_shift")
def intervention_shift(spark, sf):
    """Readout shift under known rotations of the input angle, one row per rotation."""
    d = labelled(spark, sf)
    fit = _fitted(d)
    out = None
    for deg in (-60.0, -30.0, 30.0, 60.0, 90.0):
        s = cut_lineage(L.readout_shift(fit, d, rotated(spark, sf, deg), "vec_id", "v", "theta"))
        one = L.intervention_summary(s, deg)
        out = one if out is None else out.unionByName(one)
    return out


@query("intervention_slope")
def intervention_slope(spark, sf):
    return L.shift_slope(intervention_shift(spark, sf))


@query("readout_invariance")
def readout_invariance(spark, sf):
    d = labelled(spark, sf)
    moved = V.zscore(transformed(spark, sf, "sandwich"), "v", V.dim_stats(emb(spark, sf), "v"))
    return L.invariance(d, moved, "vec_id", "v", "part")


@query("crossmodal_agreement")
def crossmodal_agreement(spark, sf):
    """Angle readouts fitted on two versions of the vectors, compared row by row."""
    d = labelled(spark, sf)
    other = d.drop("v").join(V.zscore(transformed(spark, sf, "twice"), "v").select("vec_id", "v"), "vec_id")
    held = L.is_test("vec_id")
    a = L.circular_readout(_fitted(d), d.where(held), "v", "theta", 2).select("vec_id", F.col("read_deg").alias("a"))
    b = L.circular_readout(_fitted(other), other.where(held), "v", "theta", 2).select("vec_id", F.col("read_deg").alias("b"))
    j = a.join(b, "vec_id").withColumn("gap", F.abs(angles.axial_wrap(F.col("a") - F.col("b"))))
    q = ranking.quantiles(j, "gap", [0.5], names=["median_gap"])
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gap") < 20).cast("double")).alias("within_20")).crossJoin(F.broadcast(q))


@query("axial_concentration", """
with a as (select event_type, radians(2 * (value * 3.7)) as x from events)
select event_type, round(degrees(atan2(avg(sin(x)), avg(cos(x)))) / 2, 4) as mean_angle, round(sqrt(avg(cos(x)) ** 2 + avg(sin(x)) ** 2), 6) as resultant from a group by 1""")
def axial_concentration(spark, sf):
    mean, length = L.axial_mean(F.col("value") * 3.7)
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(mean, 4).alias("mean_angle"), F.round(length, 6).alias("resultant"))


@query("periodic_versus_bounded")
def periodic_versus_bounded(spark, sf):
    """Circular probe of a periodic and of a bounded coordinate, with the plain linear probe of each."""
    d = labelled(spark, sf)
    d = d.withColumns({"full": 2 * F.col("theta"), "bounded": 60.0 * F.tanh(F.col("v")[2])})
    d = d.withColumn("forced", F.radians((F.col("bounded") + 90.0) * 2.0))
    circ = L.circular_probe(d, "vec_id", "v", "full", 1, n_boot=50).select("med_err", "loop_radius").withColumn("kind", F.lit("periodic_circular"))
    forced = L.circular_probe(d, "vec_id", "v", "forced", 1, n_boot=50).select((F.col("med_err") / 2).alias("med_err"), "loop_radius").withColumn("kind", F.lit("bounded_forced_circular"))
    lin = L.linear_angle_probe(d.withColumn("deg", F.degrees("full")), "vec_id", "v", "deg", 360.0).select("med_err", F.lit(None).cast("double").alias("loop_radius")).withColumn("kind", F.lit("periodic_linear"))
    scal = L.linear_angle_probe(d, "vec_id", "v", "bounded", 180.0).select("med_err", F.lit(None).cast("double").alias("loop_radius")).withColumn("kind", F.lit("bounded_scalar"))
    return circ.unionByName(forced).unionByName(lin).unionByName(scal)


@query("axis_validation", f"""
with {Z}, p as (select z.vec_id, list_sum(v[1:4]) as p, c.c_acctbal as b from z join customer c on c.c_custkey = z.vec_id),
r as (select p, b, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0::DOUBLE as rp, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0::DOUBLE as rb from p)
select round(corr(p, b), 6) as pearson, round(corr(rp, rb), 6) as spearman from r""")
def axis_validation(spark, sf):
    """Projection on a fixed axis against an outside attribute: linear and rank correlation."""
    w = np.zeros(64)
    w[:4] = 1.0
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("vec_id"), F.col("c_acctbal").alias("b"))
    p = V.project(zemb(spark, sf), "v", w, "p").select("vec_id", F.col("p")[0].alias("p")).join(c, "vec_id")
    p = cut_lineage(p)
    rho = L.spearman(p, "p", "b").select(F.round("rho", 6).alias("spearman"))
    return p.agg(F.round(F.corr("p", "b"), 6).alias("pearson")).crossJoin(F.broadcast(rho))


@query("error_heteroscedasticity")
def error_heteroscedasticity(spark, sf):
    d = labelled(spark, sf)
    held = cut_lineage(L.circular_readout(_fitted(d), d.where(L.is_test("vec_id")), "v", "theta", 2).withColumn("size", F.abs(F.col("third"))))
    rho, bins = L.error_by_covariate(held, "err", "size")
    partial, _ = L.error_by_covariate(held, "err", "size", "balance")
    p = partial.select(F.col("rho").alias("partial_rho"))
    return bins.crossJoin(F.broadcast(rho.select("rho"))).crossJoin(F.broadcast(p))


@query("label_noise_floor")
def label_noise_floor(spark, sf):
    """Readout error next to the propagated uncertainty of the label itself."""
    from quillon.functions import scalars

    d = labelled(spark, sf)
    held = L.circular_summary(L.circular_readout(_fitted(d), d.where(L.is_test("vec_id")), "v", "theta", 2), 2).select("med_err")
    raw = emb(spark, sf).select(scalars.angle_sigma(F.col("v")[0].cast("double"), F.col("v")[1].cast("double"), F.lit(1e4), F.lit(1e4)).alias("sigma"))
    return ranking.quantiles(raw, "sigma", [0.25, 0.5, 0.75], names=["p25", "median_sigma", "p75"]).crossJoin(F.broadcast(held))


@query("family_change")
def family_change(spark, sf):
    d = labelled(spark, sf)
    stats = cut_lineage(V.dim_stats(emb(spark, sf), "v"))
    out = None
    for name in ("sandwich", "twice"):
        for lab in ("part", "third"):
            one = L.invariance(d, V.zscore(transformed(spark, sf, name), "v", stats), "vec_id", "v", lab).select("delta_r2").withColumns({"label": F.lit(lab), "operation": F.lit(name)})
            out = one if out is None else out.unionByName(one)
    return L.by_family(out, "label", {"sandwich": "resampled once", "twice": "resampled twice"}, "operation", "delta_r2")
