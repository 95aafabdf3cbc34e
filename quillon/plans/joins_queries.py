"""Queries for key joins, positional joins and interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import hashing
from quillon.operators import intervals, joins, profiles, ranking, spatial
from quillon.plans import bindings as B
from quillon.plans.registry import query, uni
from quillon.runtime import table


@query("left_join", "select c.c_custkey, n.n_name from customer c left join (select * from nation where n_nationkey < 20) n on n.n_nationkey = c.c_nationkey")
def left_join(spark, sf):
    n = table(spark, sf, "nation").where(F.col("n_nationkey") < 20).select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(n, "c_nationkey", "left").select("c_custkey", "n_name")


@query("three_way_join", """
select n.n_name, count(*)::BIGINT as n, round(sum(o.o_totalprice), 2) as total from orders o join customer c on c.c_custkey = o.o_custkey
join nation n on n.n_nationkey = c.c_nationkey where o.o_orderstatus = 'F' group by 1""")
def three_way_join(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = o.join(c, "c_custkey").join(n, "n_nationkey")
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("composite_key_count", """
select o_orderkey, count(*) over (partition by o_custkey, o_orderstatus)::BIGINT as n_same from orders""")
def composite_key_count(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    counts = o.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_same"))
    return o.join(counts, ["o_custkey", "o_orderstatus"]).select("o_orderkey", "n_same")


@query("semi_join", "select o_orderkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) >= 12)")
def semi_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    big = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 12)
    return o.join(big, "o_custkey", "left_semi").select("o_orderkey")


@query("anti_join", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def anti_join(spark, sf):
    used = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(used, "o_orderkey", "left_anti")


# Counterparts (part) sit within about two arcseconds of a target (customer).
def counterparts(spark, sf):
    n = table(spark, sf, "customer").count()
    host = F.col("p_partkey") % F.lit(n)
    dec0 = F.degrees(F.asin(2.0 * hashing.uniform(4, host) - 1.0))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.pmod(hashing.uniform(3, host) * 360.0 + (hashing.uniform(8, "p_partkey") - 0.5) * 3.0 / 3600.0 / F.cos(F.radians(dec0)), F.lit(360.0)).alias("ra"),
        (dec0 + (hashing.uniform(9, "p_partkey") - 0.5) * 3.0 / 3600.0).alias("dec"),
    )


_H = "(p_partkey % (select count(*) from customer))"
_DEC0 = f"degrees(asin(2.0 * {uni(4, _H)} - 1.0))"
_PART = f"""(select p_partkey, ((({uni(3, _H)} * 360.0 + ({uni(8, 'p_partkey')} - 0.5) * 3.0 / 3600.0 / cos(radians({_DEC0}))) % 360.0) + 360.0) % 360.0 as ra,
  {_DEC0} + ({uni(9, 'p_partkey')} - 0.5) * 3.0 / 3600.0 as dec from part)"""
_UV = "cos(radians(dec)) * cos(radians(ra)) as ux, cos(radians(dec)) * sin(radians(ra)) as uy, sin(radians(dec)) as uz"
_PAIRS = f"""
with t as (select *, {_UV} from {B.sky_sql('customer', 'c_custkey')}), r as (select *, {_UV} from {_PART}),
p as (select t.c_custkey, r.p_partkey, degrees(2 * asin(least(sqrt((t.ux - r.ux) ** 2 + (t.uy - r.uy) ** 2 + (t.uz - r.uz) ** 2) / 2, 1.0))) * 3600.0 as sep from t, r
  where abs(t.dec - r.dec) < 0.01)"""


@query("sky_crossmatch", _PAIRS + """
select c_custkey, p_partkey, round(sep, 5) as sep from (select *, row_number() over (partition by c_custkey order by sep, p_partkey) as k from p where sep <= 1.5) where k = 1""")
def sky_crossmatch(spark, sf):
    t = B.sky_positions(spark, sf, "customer", "c_custkey")
    return spatial.sky_nearest(t, counterparts(spark, sf), "c_custkey", "p_partkey", 1.5).withColumn("sep", F.round("sep", 5))


_PLANAR = f"""
with t as (select * from {B.sky_sql('customer', 'c_custkey')}), r as (select * from {_PART}),
p as (select t.c_custkey, r.p_partkey, sqrt(((((r.ra - t.ra + 180.0) % 360.0 + 360.0) % 360.0 - 180.0) * cos(radians(t.dec))) ** 2 + (r.dec - t.dec) ** 2) * 3600.0 as sep
  from t, r where abs(t.dec - r.dec) < 0.01)"""


@query("sky_crossmatch_planar", _PLANAR + """
select c_custkey, p_partkey, round(sep, 5) as sep from (select *, row_number() over (partition by c_custkey order by sep, p_partkey) as k from p where sep <= 1.5) where k = 1""")
def sky_crossmatch_planar(spark, sf):
    t = B.sky_positions(spark, sf, "customer", "c_custkey")
    return spatial.sky_nearest(t, counterparts(spark, sf), "c_custkey", "p_partkey", 1.5, metric="planar").withColumn("sep", F.round("sep", 5))


@query("sky_all_counterparts", _PLANAR + f"""
select t.c_custkey, p.p_partkey, round(p.sep, 5) as sep from {B.sky_sql('customer', 'c_custkey')} t left join (select * from p where sep <= 1.6) p using (c_custkey)""")
def sky_all_counterparts(spark, sf):
    t = B.sky_positions(spark, sf, "customer", "c_custkey")
    return spatial.sky_all(t, counterparts(spark, sf), "c_custkey", "p_partkey", 1.6).withColumn("sep", F.round("sep", 5))


@query("asof_step_join", """
with s as (select user_id, ts, value from (select *, row_number() over (partition by user_id, ts order by value desc) as k from events where event_type = 'signup') where k = 1)
select e.event_id, s.value from (select * from events where event_type = 'error') e asof left join s on e.user_id = s.user_id and e.ts >= s.ts""")
def asof_step_join(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    left = e.where(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    right = e.where(F.col("event_type") == "signup").select("user_id", "ts", "value")
    return joins.asof_join(left, right, "ts", ["value"], ["user_id"]).select("event_id", "value")


@query("interp_grid", """
with g as (select l_linenumber as node, avg(l_extendedprice) as y from lineitem group by 1),
o as (select o_orderkey, o_totalprice / 100000.0 + 1 as x from orders),
c as (select o_orderkey, least(greatest(x - 1, 0.0), 6.0) as pos from o)
select o_orderkey, round(a.y + (coalesce(b.y, a.y) - a.y) * (pos - floor(pos)), 4) as y from c join g a on a.node - 1 = floor(pos) left join g b on b.node = a.node + 1""")
def interp_grid(spark, sf):
    g = table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("long").alias("node")).agg(F.avg("l_extendedprice").alias("y"))
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000.0 + 1).alias("x"))
    return joins.grid_interpolate(o, "x", g, "node", "y", 1.0, 1.0, "yi").select("o_orderkey", F.round("yi", 4).alias("y"))


@query("interval_segment_agg", """
with w as (select o_orderkey, o_orderkey * 8 + 1 as off, 1 + o_orderkey % 7 as n from orders),
r as (select l_orderkey * 8 + l_linenumber as idx, l_quantity, l_extendedprice, l_discount from lineitem)
select w.o_orderkey, count(*)::BIGINT as n, round(sum(l_quantity), 2) as quantity, round(sum(case when l_discount > 0.05 then l_extendedprice else 0.0 end), 2) as discounted
from r join w on r.idx >= w.off and r.idx < w.off + w.n group by 1""")
def interval_segment_agg(spark, sf):
    w = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 8 + 1).alias("off"), (1 + F.col("o_orderkey") % 7).alias("n"))
    r = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), "l_quantity", "l_extendedprice", "l_discount")
    m = intervals.interval_join(r, w, "idx", "off", "n")
    return m.groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).otherwise(0.0)), 2).alias("discounted"),
    )


_MI = lambda a: f"(p{a} - {a} - {B.BOX} * round_even((p{a} - {a}) / {B.BOX}, 0))"
_MEMBERS = f"""
with w as (select * from {B.owners_sql()}), m as (select * from {B.members_sql()}),
j as (select w.*, m.mass, greatest(m.age, 0.0) as age, m.metal, {_MI('x')} ** 2 + {_MI('y')} ** 2 + {_MI('z')} ** 2 as r2,
  (px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2 as q2
  from w join m on m.row_idx >= w."offset" and m.row_idx < w."offset" + w.n_rows)"""


@query("aperture_aggregates", _MEMBERS + """,
s as (select c_custkey, sum(mass) as mt, sum(mass * (r2 < (2 * radius) ** 2)::INT) as m2, sum(mass * (r2 < radius ** 2)::INT) as m1, count_if(r2 < (2 * radius) ** 2) as n2,
  sum(mass * age) as a, sum(mass * age * (r2 < (2 * radius) ** 2)::INT) as a2, sum(mass * metal * (r2 < (2 * radius) ** 2)::INT) as z2,
  sum(mass * (r2 < (2 * radius) ** 2 and age < 0.1)::INT) as s100, sum(mass * (r2 < (2 * radius) ** 2 and age < 0.01)::INT) as s10 from j group by 1)
select w.c_custkey, round(coalesce(mt, 0), 2) as mass_total, case when radius > 0 then round(coalesce(m2, 0), 2) end as mass_in2, case when radius > 0 then round(coalesce(m1, 0), 2) end as mass_in1,
  coalesce(n2, 0)::BIGINT as n_in2, round(case when mt > 0 then a / mt end, 6) as mean_age, round(case when radius > 0 and m2 > 0 then a2 / m2 end, 6) as mean_age_in2,
  round(case when radius > 0 and m2 > 0 then z2 / m2 end, 6) as mean_metal_in2, case when radius > 0 then round(coalesce(s100, 0) / 1e8, 10) end as rate_100, case when radius > 0 then round(coalesce(s10, 0) / 1e7, 10) end as rate_10,
  case when not radius > 0 then 'radius<=0' when coalesce(n2, 0) = 0 then 'empty' else '' end as flag from w left join s using (c_custkey)""")
def aperture_aggregates(spark, sf):
    w = B.owners(spark, sf)
    m = intervals.interval_join(B.members(spark, sf), w, "row_idx", "offset", "n_rows")
    out = intervals.member_aggregates(m, w, "c_custkey", "mass", "age", "metal", "radius", B.BOX)
    digits = {"mass_total": 2, "mass_in2": 2, "mass_in1": 2, "mean_age": 6, "mean_age_in2": 6, "mean_metal_in2": 6, "rate_100": 10, "rate_10": 10}
    return out.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


@query("aperture_gate", _MEMBERS + """,
s as (select c_custkey, any_value(n_rows) as n_rows, sum(mass * (r2 < radius ** 2)::INT) / sum(mass) as ratio from j where radius > 0 group by 1)
select (case when n_rows < 6 then 0 when n_rows < 8 then 1 else 2 end)::INT as bin, count(*)::BIGINT as n, round(quantile_cont(ratio, 0.25), 6) as p25,
 round(quantile_cont(ratio, 0.5), 6) as median, round(quantile_cont(ratio, 0.75), 6) as p75 from s group by 1""")
def aperture_gate(spark, sf):
    """Quality gate: share of mass inside one radius, by member-count bin."""
    w = B.owners(spark, sf)
    m = intervals.interval_join(B.members(spark, sf), w, "row_idx", "offset", "n_rows")
    agg = intervals.member_aggregates(m, w, "c_custkey", "mass", "age", "metal", "radius", B.BOX)
    good = agg.where((F.col("mass_total") > 0) & F.col("mass_in1").isNotNull()).join(w.select("c_custkey", "n_rows"), "c_custkey")
    good = good.withColumn("ratio", F.col("mass_in1") / F.col("mass_total"))
    out = profiles.binned_profile(good, profiles.edge_bin("n_rows", [0, 6, 8, 1000]), "ratio", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return out.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("p25", "median", "p75")])


@query("periodic_wrap_check", _MEMBERS + f""",
f as (select * from j where least(x, {B.BOX} - x, y, {B.BOX} - y, z, {B.BOX} - z) < radius and radius > 0)
select c_custkey, count(*)::BIGINT as n, count_if(abs(r2 - q2) > 1e-6)::BIGINT as n_wrapped, round(sqrt(max(q2)), 4) as naive_max_r, round(sqrt(max(r2)), 4) as wrapped_max_r,
  round(sum(case when q2 < (2 * radius) ** 2 then mass else 0.0 end), 2) as naive_mass, round(sum(case when r2 < (2 * radius) ** 2 then mass else 0.0 end), 2) as wrapped_mass from f group by 1""")
def periodic_wrap_check(spark, sf):
    cand = intervals.face_candidates(B.owners(spark, sf), "radius", B.BOX)
    m = intervals.interval_join(B.members(spark, sf), cand, "row_idx", "offset", "n_rows")
    out = intervals.naive_versus_wrapped(m, "c_custkey", "mass", "radius", B.BOX)
    digits = {"naive_max_r": 4, "wrapped_max_r": 4, "naive_mass": 2, "wrapped_mass": 2}
    return out.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


_NN = f"""
with a as (select p_partkey as a_id, {B.box_sql('p_partkey')} from part), b as (select p_partkey as b_id, {B.later_sql('p_partkey')} from part),
d as (select a_id, b_id, sqrt((b.x - a.x - {B.BOX} * round_even((b.x - a.x) / {B.BOX}, 0)) ** 2 + (b.y - a.y - {B.BOX} * round_even((b.y - a.y) / {B.BOX}, 0)) ** 2
  + (b.z - a.z - {B.BOX} * round_even((b.z - a.z) / {B.BOX}, 0)) ** 2) as sep from a, b),
fa as (select a_id, min((sep, b_id)) as m from d group by 1), fb as (select b_id, min((sep, a_id)) as m from d group by 1)"""


@query("mutual_nn_periodic", _NN + """
select fa.a_id, fa.m[2] as b_id, round(fa.m[1], 6) as sep from fa join fb on fb.b_id = fa.m[2] and fb.m[2] = fa.a_id where fa.m[1] < 25""")
def mutual_nn_periodic(spark, sf):
    p = table(spark, sf, "part").select("p_partkey")
    a = B.box_positions(p, "p_partkey").withColumnRenamed("p_partkey", "a_id")
    b = B.later_positions(p, "p_partkey").withColumnRenamed("p_partkey", "b_id")
    return spatial.mutual_nearest_periodic(a, b, "a_id", "b_id", B.BOX, 25.0).withColumn("sep", F.round("sep", 6))


@query("compare_tables", """
with a as (select c_custkey as k, c_acctbal as v, c_nationkey as n from customer), b as (select c_custkey + 3 as k, c_acctbal * 1.01 as v, c_nationkey as n from customer)
select count(a.k)::BIGINT as n_left, count(b.k)::BIGINT as n_right, count_if(a.k is not null and b.k is not null)::BIGINT as n_both,
  count_if(a.k is not null and b.k is not null and a.v is not distinct from b.v)::BIGINT as v_equal, round(max(abs(a.v - b.v)), 4) as v_max_abs,
  count_if(a.k is not null and b.k is not null and a.n is not distinct from b.n)::BIGINT as n_equal, max(abs(a.n - b.n)) as n_max_abs
from a full join b on a.k = b.k""")
def compare_tables(spark, sf):
    c = table(spark, sf, "customer")
    a = c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("n"))
    b = c.select((F.col("c_custkey") + 3).alias("k"), (F.col("c_acctbal") * 1.01).alias("v"), F.col("c_nationkey").alias("n"))
    return joins.compare_tables(a, b, "k", ["v", "n"]).withColumn("v_max_abs", F.round("v_max_abs", 4))


@query("value_targeted_picks", """
with p as (select unnest([0.1, 0.3, 0.5, 0.7, 0.9]) as q), t as (select q, (select quantile_cont(o_totalprice, 0.1) from orders) as x from p where q = 0.1
 union all select q, (select quantile_cont(o_totalprice, 0.3) from orders) from p where q = 0.3 union all select q, (select quantile_cont(o_totalprice, 0.5) from orders) from p where q = 0.5
 union all select q, (select quantile_cont(o_totalprice, 0.7) from orders) from p where q = 0.7 union all select q, (select quantile_cont(o_totalprice, 0.9) from orders) from p where q = 0.9),
r as (select t.q, o.o_orderkey, row_number() over (partition by t.q order by abs(o.o_totalprice - t.x), o.o_orderkey) as k from t, orders o)
select q::DOUBLE as q, o_orderkey from r where k = 1""")
def value_targeted_picks(spark, sf):
    from quillon.operators.sampling import percentile_picks

    return percentile_picks(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", [0.1, 0.3, 0.5, 0.7, 0.9])
