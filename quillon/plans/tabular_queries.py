"""Queries for filters, aggregations, windows and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import angles, cosmology, hashing, scalars
from quillon.operators import profiles, ranking, selection
from quillon.plans.registry import h32, query, uni
from quillon.runtime import table

LM = "log10(l_extendedprice)"
ZB = "(l_discount + 0.075)"  # a redshift-like small positive number


def _r(df, digits: int, *cols):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---- filters and labels -------------------------------------------------------------------------------------

@query("range_filter", "select l_orderkey, l_discount, l_tax from lineitem where l_discount > 0 and l_discount < 0.07 and l_tax is not null")
def range_filter(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_discount", "l_tax")
    return df.where(selection.in_open_range("l_discount", 0, 0.07) & F.col("l_tax").isNotNull())


@query("seeded_sample", f"select o_orderkey, o_totalprice from orders order by {h32(7, 'o_orderkey')}, o_orderkey limit 500")
def seeded_sample(spark, sf):
    return ranking.sample_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 7)


@query("populations", """
with o as (select o_totalprice > 250000 as rich, o_orderstatus = 'F' as done, o_orderpriority = '1-URGENT' as urgent from orders)
select 'rich' as population, count_if(rich)::BIGINT as n from o union all select 'done', count_if(done)::BIGINT from o
union all select 'rich_done', count_if(rich and done)::BIGINT from o union all select 'urgent', count_if(urgent)::BIGINT from o""")
def populations(spark, sf):
    rich, done = F.col("o_totalprice") > 250000, F.col("o_orderstatus") == "F"
    masks = {"rich": rich, "done": done, "rich_done": rich & done, "urgent": F.col("o_orderpriority") == "1-URGENT"}
    return selection.population_counts(table(spark, sf, "orders"), masks)


@query("two_threshold_label", """
select label, count(*)::BIGINT as n from (select (case when o_totalprice > 350000 then 1 when o_totalprice < 150000 then 0 else -1 end)::INT as label from orders) group by 1""")
def two_threshold_label(spark, sf):
    label = selection.two_threshold_label("o_totalprice", 150000, 350000)
    return table(spark, sf, "orders").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("code_group", """
select footprint, count(*)::BIGINT as n from (select case when nullif(c_nationkey, 3) = 11 then 'north' else 'south' end as footprint from customer) group by 1""")
def code_group(spark, sf):
    code = F.nullif(F.col("c_nationkey"), F.lit(3))
    group = selection.code_group(code, 11, "north", "south")
    return table(spark, sf, "customer").groupBy(group.alias("footprint")).agg(F.count(F.lit(1)).alias("n"))


# Lower edges of the redshift steps and the snapshot each maps to.
STEPS = {0.075: "771", 0.125: "771", 0.15: "743", 0.20: "743", 0.25: "743r", 0.30: "743r", 0.35: "692", 0.40: "692", 0.45: "692", 0.50: "660"}


@query("step_lookup", """
with s(edge, snap) as (values (0.075,'771'),(0.125,'771'),(0.15,'743'),(0.20,'743'),(0.25,'743r'),(0.30,'743r'),(0.35,'692'),(0.40,'692'),(0.45,'692'),(0.50,'660')),
o as (select o_orderkey, o_totalprice / 1000000.0 as z from orders)
select o.o_orderkey, round(o.z, 8) as z, coalesce(s.snap, '771') as snap from o asof left join s on o.z + 1e-9 >= s.edge""")
def step_lookup(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000000.0).alias("z"))
    return o.select("o_orderkey", F.round("z", 8).alias("z"), selection.step_lookup("z", STEPS).alias("snap"))


@query("try_cast", """
select event_id, try_cast(case when event_type = 'error' then event_type else value::VARCHAR end as DOUBLE) as value from events""")
def try_cast(spark, sf):
    text = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", text.try_cast("double").alias("value"))


@query("impute_median", f"""
with s as (select c_custkey, case when {h32(5, 'c_custkey')} % 4 = 0 then null else c_acctbal end as bal,
  case when {h32(6, 'c_custkey')} % 5 = 0 then null else c_nationkey::DOUBLE end as nation from customer)
select c_custkey, round(coalesce(bal, (select quantile_cont(bal, 0.5) from s)), 6) as bal,
  coalesce(nation, (select quantile_cont(nation, 0.5) from s)) as nation from s""")
def impute_median(spark, sf):
    s = table(spark, sf, "customer").select(
        "c_custkey", F.when(hashing.hash32(5, "c_custkey") % 4 != 0, F.col("c_acctbal")).alias("bal"),
        F.when(hashing.hash32(6, "c_custkey") % 5 != 0, F.col("c_nationkey").cast("double")).alias("nation"),
    )
    return _r(selection.impute_median(s, ["bal", "nation"]), 6, "bal")


# ---- aggregations -------------------------------------------------------------------------------------------

@query("uniqueness", """
select count(*)::BIGINT as n_rows, count(distinct l_orderkey)::BIGINT as n_unique, (count(*) - count(distinct l_orderkey))::BIGINT as n_duplicate,
  min(l_quantity) as min, max(l_quantity) as max from lineitem""")
def uniqueness(spark, sf):
    return profiles.uniqueness(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity")


@query("chain_length_dist", """
select length, count(*)::BIGINT as n_keys from (select o_custkey, count(distinct year(o_orderdate))::BIGINT as length from orders group by 1) group by 1""")
def chain_length_dist(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return profiles.distinct_count_histogram(o, "o_custkey", "year")


@query("group_spread", """
with s as (select log10(max(o_totalprice) / min(o_totalprice)) as s from orders group by o_custkey having count(*) >= 2)
select count(*)::BIGINT as n_groups, round(avg((s > 0.8)::INT), 6) as share_above, round(quantile_cont(s, 0.5), 6) as median, round(quantile_cont(s, 0.95), 6) as p95 from s""")
def group_spread(spark, sf):
    return _r(profiles.group_spread(table(spark, sf, "orders"), "o_custkey", "o_totalprice", 0.8), 6, "share_above", "median", "p95")


@query("binned_profile", f"""
with l as (select floor(({LM} - 2.5) / 0.25)::INT as bin, l_quantity from lineitem)
select bin, count(*)::BIGINT as n, round(avg((l_quantity > 40)::INT), 6) as share_high, round(quantile_cont(l_quantity, 0.05), 6) as p5,
  round(quantile_cont(l_quantity, 0.5), 6) as median, round(quantile_cont(l_quantity, 0.95), 6) as p95 from l group by 1""")
def binned_profile(spark, sf):
    l = table(spark, sf, "lineitem").select("l_quantity", F.log10("l_extendedprice").alias("lm"))
    out = profiles.binned_profile(
        l, profiles.bin_index("lm", 2.5, 0.25), "l_quantity", {"p5": 0.05, "median": 0.5, "p95": 0.95},
        {"share_high": F.avg((F.col("l_quantity") > 40).cast("double"))},
    )
    return _r(out, 6, "share_high", "p5", "median", "p95")


@query("edge_binned_profile", """
with b as (select case when o_totalprice >= 0 and o_totalprice < 100000 then 0 when o_totalprice >= 100000 and o_totalprice < 200000 then 1
  when o_totalprice >= 200000 and o_totalprice <= 400000 then 2 end::INT as bin, o_totalprice as v from orders)
select bin, count(*)::BIGINT as n, round(quantile_cont(v, 0.5), 4) as median from b where bin is not null group by 1""")
def edge_binned_profile(spark, sf):
    b = profiles.edge_bin("o_totalprice", [0, 100000, 200000, 400000], closed_last=True)
    return _r(profiles.binned_profile(table(spark, sf, "orders"), b, "o_totalprice", {"median": 0.5}), 4, "median")


@query("quantile_profile", """
with e as (select list(quantile_cont) as e from (select unnest(quantile_cont(l_extendedprice, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) as quantile_cont from lineitem)),
b as (select (case when l_extendedprice >= e.e[10] then 9 when l_extendedprice >= e.e[9] then 8 when l_extendedprice >= e.e[8] then 7 when l_extendedprice >= e.e[7] then 6
 when l_extendedprice >= e.e[6] then 5 when l_extendedprice >= e.e[5] then 4 when l_extendedprice >= e.e[4] then 3 when l_extendedprice >= e.e[3] then 2
 when l_extendedprice >= e.e[2] then 1 else 0 end)::INT as bin, l_quantity from lineitem, e)
select bin, count(*)::BIGINT as n, round(quantile_cont(l_quantity, 0.5), 6) as median, round(quantile_cont(l_quantity, 0.95), 6) as p95 from b group by 1""")
def quantile_profile(spark, sf):
    l = profiles.quantile_bin(table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity"), "l_extendedprice", 10, "q")
    return _r(profiles.binned_profile(l, F.col("q"), "l_quantity", {"median": 0.5, "p95": 0.95}), 6, "median", "p95")


@query("lumfn", """
with m as (select 22.5 - 2.5 * log10(l_extendedprice) as m from lineitem),
b as (select case when m = 15.5 then 15 else floor((m - 7.5) / 0.5) end::INT as bin, count(*) as n from m where m >= 7.5 and m <= 15.5 group by 1)
select r.range::INT as bin, 7.5 + (r.range + 0.5) * 0.5 as center, coalesce(b.n, 0)::BIGINT as n, round(coalesce(b.n, 0) / (1000.0 * 0.5), 6) as density
from range(16) r left join b on b.bin = r.range""")
def lumfn(spark, sf):
    m = table(spark, sf, "lineitem").select(scalars.flux_to_mag("l_extendedprice").alias("m"))
    return _r(profiles.histogram(m, "m", 7.5, 0.5, 16, 1000.0), 6, "density")


@query("hist2d", f"""
with l as (select floor({ZB} / 0.02)::INT as xbin, floor(({LM} - 2.5) / 0.1)::INT as ybin from lineitem), t as (select count(*) as t from l)
select xbin, ybin, count(*)::BIGINT as n, round(count(*) * 50000.0 / any_value(t.t), 6) as target from l, t group by 1, 2""")
def hist2d(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_discount") + 0.075).alias("z"), F.log10("l_extendedprice").alias("lm"))
    return _r(profiles.histogram_2d(l, profiles.bin_index("z", 0.0, 0.02), profiles.bin_index("lm", 2.5, 0.1), 50000), 6, "target")


@query("circular_occupancy", """
with b as (select floor(((value * 7.0) % 180.0) / 5.0)::INT as bin, count(*) as n from events group by 1),
f as (select coalesce(b.n, 0) as n from range(36) r left join b on b.bin = r.range)
select round(avg((n > 0)::INT), 6) as occupied, min(n)::BIGINT as min_n, max(n)::BIGINT as max_n from f""")
def circular_occupancy(spark, sf):
    e = table(spark, sf, "events").select((F.col("value") * 7.0).alias("pa"))
    return _r(profiles.circular_occupancy(e, "pa", 180.0, 36), 6, "occupied")


@query("ess", """
select l_returnflag, count(*)::BIGINT as n, round(sum(l_quantity * (l_discount > 0.05)::INT) / sum(l_quantity), 6) as weighted_mean,
  round(avg((l_discount > 0.05)::INT), 6) as raw_mean, round(sum(l_quantity) ** 2 / sum(l_quantity * l_quantity), 4) as ess from lineitem group by 1""")
def ess(spark, sf):
    q = (F.col("l_discount") > 0.05).cast("double")
    out = profiles.weighted_summary(table(spark, sf, "lineitem"), ["l_returnflag"], q, "l_quantity")
    return _r(_r(out, 6, "weighted_mean", "raw_mean"), 4, "ess")


_RES = "((l_extendedprice / 40000.0) - (l_quantity / 25.0)) / (1 + l_quantity / 25.0)"


@query("robust_scatter", f"""
with d as (select l_returnflag, {_RES} as dz from lineitem), m as (select l_returnflag, quantile_cont(dz, 0.5) as bias from d group by 1)
select d.l_returnflag, count(*)::BIGINT as n, round(any_value(m.bias), 6) as bias, round(1.4826 * quantile_cont(abs(dz - m.bias), 0.5), 6) as sigma_mad,
  round(avg((abs(dz) > 0.15)::INT), 6) as outlier_share, round(sqrt(avg(dz * dz)), 6) as rms from d join m using (l_returnflag) group by 1""")
def robust_scatter(spark, sf):
    d = table(spark, sf, "lineitem").select(
        "l_returnflag", scalars.relative_residual(F.col("l_extendedprice") / 40000.0, F.col("l_quantity") / 25.0).alias("dz")
    )
    return _r(profiles.robust_scatter(d, "dz", ["l_returnflag"]), 6, "bias", "sigma_mad", "outlier_share", "rms")


@query("convention_diff", """
with d as (select l_linestatus, l_extendedprice * (1 - l_discount) as new, l_extendedprice * (1 - l_tax) as old, l_quantity as base from lineitem),
r as (select *, case when greatest(new, old) > 0 then (greatest(new, old) - least(new, old)) / greatest(new, old) else 0 end as rel from d)
select l_linestatus, count(*)::BIGINT as n, count_if(greatest(new, old) = 0)::BIGINT as both_zero,
  round(avg(case when rel > 0 then (new < old)::INT end), 6) as new_lower_of_differing, round(avg((rel > 0.05)::INT), 6) as share_gt_5pct,
  round(avg((rel > 0.2)::INT), 6) as share_gt_20pct, round(avg((rel > 0.5)::INT), 6) as share_gt_2x,
  round(avg(case when base > 0 then (new / base < 1400)::INT end), 6) as class_share_new, round(avg(case when base > 0 then (old / base < 1400)::INT end), 6) as class_share_old,
  round(quantile_cont(rel, 0.5), 6) as median_rel, round(quantile_cont(rel, 0.9), 6) as p90_rel from r group by 1""")
def convention_diff(spark, sf):
    l = table(spark, sf, "lineitem").select(
        "l_linestatus", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("new"),
        (F.col("l_extendedprice") * (1 - F.col("l_tax"))).alias("old"), F.col("l_quantity").alias("base"),
    )
    out = profiles.convention_difference(l, "new", "old", "base", 1400, ["l_linestatus"])
    return _r(out, 6, *[c for c in out.columns if c not in ("l_linestatus", "n", "both_zero")])


_OFF = """
with d as (select log10(l_extendedprice) - log10(l_quantity * 1400) as off, log10(l_extendedprice) as col from lineitem),
e as (select quantile_cont(col, 0.01) as lo, quantile_cont(col, 0.99) as hi from d),
b as (select d.off, case when col >= lo and col < hi then least(floor((col - lo) / ((hi - lo) / 10)), 9)::INT end as bin from d, e),
m as (select bin, quantile_cont(off, 0.5) as med from b where bin is not null group by 1)"""


@query("offset_by_colour", _OFF + """
select b.bin, count(*)::BIGINT as n, round(stddev_pop(off), 6) as std, round(quantile_cont(off, 0.5), 6) as median_offset,
  round(any_value(e.lo + (b.bin + 0.5) * (e.hi - e.lo) / 10), 6) as center from b, e where bin is not null group by 1""")
def offset_by_colour(spark, sf):
    per_bin, _ = profiles.offset_by_colour(_offsets(spark, sf), "off", "colour")
    return _r(per_bin, 6, "std", "median_offset", "center")


@query("offset_residual", _OFF + """
select round(stddev_pop(b.off), 6) as std, round(quantile_cont(b.off, 0.05), 6) as p5, round(quantile_cont(b.off, 0.5), 6) as median, round(quantile_cont(b.off, 0.95), 6) as p95,
  (select round(stddev_pop(b2.off - m.med), 6) from b b2 join m on m.bin = b2.bin) as residual_std from b""")
def offset_residual(spark, sf):
    _, summary = profiles.offset_by_colour(_offsets(spark, sf), "off", "colour")
    return _r(summary, 6, "std", "p5", "median", "p95", "residual_std")


def _offsets(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.log10("l_extendedprice") - F.log10(F.col("l_quantity") * 1400)).alias("off"), F.log10("l_extendedprice").alias("colour")
    )


@query("group_distinct_broadcast", """
select o.o_orderkey, c.n_years from orders o join (select o_custkey, count(distinct year(o_orderdate))::BIGINT as n_years from orders group by 1) c using (o_custkey)""")
def group_distinct_broadcast(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    return profiles.with_distinct_count(o, "o_custkey", "year", "n_years").select("o_orderkey", "n_years")


# ---- windows, sorting, sets ---------------------------------------------------------------------------------

@query("first_per_key", """
select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as r from orders) where r = 1""")
def first_per_key(spark, sf):
    return ranking.first_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query("topk_per_group", """
select o_custkey, o_orderkey, rank::INT as rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3""")
def topk_per_group(spark, sf):
    return ranking.top_k(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).drop("o_totalprice")


@query("average_rank", """
select distinct l_returnflag, l_quantity, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0::DOUBLE as avg_rank from lineitem""")
def average_rank(spark, sf):
    return ranking.average_ranks(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_returnflag", "l_quantity", "avg_rank")


@query("empirical_cdf", """
select value, row_number() over (order by value)::BIGINT as i, round((row_number() over (order by value) - 0.5::DOUBLE) / count(*) over (), 8) as cdf from events""")
def empirical_cdf(spark, sf):
    return _r(ranking.ecdf(table(spark, sf, "events").select("value"), "value"), 8, "cdf")


@query("cumulative_components", """
with v as (select l_linenumber as k, var_pop(l_extendedprice) as v from lineitem group by 1),
c as (select row_number() over (order by v desc, k) as n, sum(v) over (order by v desc, k rows unbounded preceding) as c, sum(v) over () as t from v)
select s.share::DOUBLE as share, min(c.n)::INT as n_components from c, (values (0.5), (0.9), (0.95), (0.99)) s(share) where c.c >= s.share * c.t group by 1""")
def cumulative_components(spark, sf):
    v = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("comp")).agg(F.var_pop("l_extendedprice").alias("v"))
    return profiles.cumulative_components(v, "comp", "v", [0.5, 0.9, 0.95, 0.99])


@query("cumulative_trapezoid", """
with g as (select range as node, range * 0.01 as z, 1 / sqrt(0.3089 * (1 + range * 0.01) ** 3 + 0.6911) as f from range(101)),
s as (select node, z, coalesce(0.5 * (f + lag(f) over (order by node)) * 0.01, 0) as p from g),
d as (select node, z, 299792.458 / 67.74 * sum(p) over (order by node) as dc from s),
o as (select o_orderkey, o_totalprice / 1000000.0 as z from orders),
j as (select o.o_orderkey, o.z, a.dc + (b.dc - a.dc) * (o.z / 0.01 - a.node) as dc from o join d a on a.node = floor(o.z / 0.01) join d b on b.node = a.node + 1)
select o_orderkey, round(dc, 4) as dc, round(5 * log10(greatest((1 + z) * dc, 1e-6) * 1e5), 6) as dm from j""")
def cumulative_trapezoid(spark, sf):
    from quillon.operators.joins import grid_interpolate

    grid = cosmology.distance_grid(spark, 67.74, 0.3089, 1.0, 100)
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000000.0).alias("z"))
    out = grid_interpolate(o, "z", grid, "node", "dc_mpc", 0.0, 0.01, "dc")
    return out.select("o_orderkey", F.round("dc", 4).alias("dc"), F.round(cosmology.distance_modulus("z", F.col("dc")), 6).alias("dm"))


@query("largest_gaps", """
with t as (select o_totalprice, row_number() over (order by o_totalprice desc) as i, o_totalprice - lead(o_totalprice) over (order by o_totalprice desc) as gap from orders)
select i::INT as i, o_totalprice, round(gap, 6) as gap from t where i <= 8""")
def largest_gaps(spark, sf):
    return _r(profiles.largest_gaps(table(spark, sf, "orders"), "o_totalprice", 8), 6, "gap")


@query("union_with_source", """
select source, count(*)::BIGINT as n, round(sum(bal), 2) as bal from (select 'customer' as source, c_acctbal as bal from customer union all select 'supplier', s_acctbal from supplier) group by 1""")
def union_with_source(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_acctbal").alias("bal"))
    return _r(c.unionByName(s).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("bal").alias("bal")), 2, "bal")


@query("id_set_difference", "select distinct p_partkey as id from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def id_set_difference(spark, sf):
    used = table(spark, sf, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_partkey").alias("id"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id")).join(used, "id", "left_anti")


@query("id_set_intersection", "select p_partkey as id from part where p_partkey in (select l_partkey from lineitem where l_quantity > 45)")
def id_set_intersection(spark, sf):
    used = table(spark, sf, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_partkey").alias("id"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id")).join(used, "id", "left_semi")


# ---- scalar functions ---------------------------------------------------------------------------------------

@query("flux_and_magnitude", """
select o_orderkey, round(22.5 - 2.5 * log10(greatest(o_totalprice, 1e-9)), 6) as mag, round(pow(10, (22.5 - (o_totalprice / 20000.0)) / 2.5), 2) as flux,
  coalesce(2.5 * log10((o_totalprice / 1000.0) / nullif(o_orderkey % 400, 0)) + 0.64 > 0.8, false) as red,
  round(2.5 * log10((o_totalprice / 1000.0) / nullif(o_orderkey % 400, 0)) + 0.64, 6) as colour from orders""")
def flux_and_magnitude(spark, sf):
    colour = scalars.flux_colour(F.col("o_orderkey") % 400, F.col("o_totalprice") / 1000.0)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(scalars.flux_to_mag("o_totalprice"), 6).alias("mag"),
        F.round(scalars.mag_to_flux(F.col("o_totalprice") / 20000.0), 2).alias("flux"),
        scalars.flag(colour > 0.8).alias("red"), F.round(colour, 6).alias("colour"),
    )


_E1, _E2 = "embedding[1]::DOUBLE", "embedding[2]::DOUBLE"


@query("shape_columns", f"""
with s as (select vec_id, {_E1} as e1, {_E2} as e2, abs(embedding[3]::DOUBLE) * 1000 as i1, abs(embedding[4]::DOUBLE) * 1000 as i2 from embeddings),
e as (select *, sqrt(e1 * e1 + e2 * e2) as e from s)
select vec_id, round(e, 6) as ellip, round((1 - e) / (1 + e), 6) as ba, round(((degrees(0.5 * atan2(e2, e1)) % 180.0) + 180.0) % 180.0, 6) as pa,
  round(degrees(acos(least(greatest((1 - e) / (1 + e), 0.0), 1.0))), 6) as incl, round(e / sqrt(1 / i1 + 1 / i2), 6) as snr,
  round(degrees(sqrt((e2 * e2 / i1 + e1 * e1 / i2) / (e1 * e1 + e2 * e2) ** 2)) / 2, 6) as sigma_pa from e""")
def shape_columns(spark, sf):
    at = lambda i: F.element_at("embedding", i).cast("double")
    s = table(spark, sf, "embeddings").select("vec_id", at(1).alias("e1"), at(2).alias("e2"), (F.abs(at(3)) * 1000).alias("i1"), (F.abs(at(4)) * 1000).alias("i2"))
    out = s.select(
        "vec_id", scalars.ellipticity("e1", "e2").alias("ellip"), scalars.axis_ratio("e1", "e2").alias("ba"),
        scalars.position_angle("e1", "e2").alias("pa"), scalars.inclination(scalars.axis_ratio("e1", "e2")).alias("incl"),
        scalars.shape_snr("e1", "e2", "i1", "i2").alias("snr"), scalars.angle_sigma("e1", "e2", "i1", "i2").alias("sigma_pa"),
    )
    return _r(out, 6, "ellip", "ba", "pa", "incl", "snr", "sigma_pa")


@query("axial_wrap_error", """
with a as (select event_id, value * 3.7 as a, event_id * 1.3 as b from events)
select event_id, round((((a + 90.0) % 180.0) + 180.0) % 180.0 - 90.0, 6) as wrapped,
  round(degrees(abs(atan2(sin(2 * radians(a) - 2 * radians(b)), cos(2 * radians(a) - 2 * radians(b))))) / 2, 6) as err, 45.0::DOUBLE as chance from a""")
def axial_wrap_error(spark, sf):
    a = table(spark, sf, "events").select("event_id", (F.col("value") * 3.7).alias("a"), (F.col("event_id") * 1.3).alias("b"))
    err = angles.circular_error(2 * F.radians("a"), 2 * F.radians("b"), 2)
    return a.select("event_id", F.round(angles.axial_wrap("a"), 6).alias("wrapped"), F.round(err, 6).alias("err"), angles.chance_floor(2).alias("chance"))


@query("sky_unit_vectors", f"""
with p as (select c_custkey, radians({uni(3, 'c_custkey')} * 360.0) as ra, asin(2.0 * {uni(4, 'c_custkey')} - 1.0) as dec from customer),
u as (select c_custkey, cos(dec) * cos(ra) as x, cos(dec) * sin(ra) as y, sin(dec) as z from p)
select c_custkey, round(x, 8) as x, round(y, 8) as y, round(z, 8) as z, round(degrees(2 * asin(least(sqrt((x - 1) ** 2 + y * y + z * z) / 2, 1.0))) * 3600.0, 4) as sep from u""")
def sky_unit_vectors(spark, sf):
    from quillon.plans.bindings import sky_positions

    p = sky_positions(spark, sf, "customer", "c_custkey")
    x, y, z = angles.unit_vector("ra", "dec")
    u = p.select("c_custkey", x.alias("x"), y.alias("y"), z.alias("z"))
    chord = F.sqrt(F.pow(F.col("x") - 1, 2) + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return _r(u.withColumn("sep", F.round(angles.chord_to_arcsec(chord), 4)), 8, "x", "y", "z")


@query("min_image", """
select event_id, round((value * 100 - event_id * 3.0) - 2500.0 * round_even((value * 100 - event_id * 3.0) / 2500.0, 0), 6) as d from events""")
def min_image(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(angles.min_image(F.col("value") * 100 - F.col("event_id") * 3.0, 2500.0), 6).alias("d"))


@query("snapshot_grid", """
with a as (select o_orderkey, 1.0 / (1.0 + o_totalprice / 100000.0) as a from orders),
t as (select o_orderkey, a, 1 / a - 1 as z, 3.0856775814913673e19 / 67.74 / 3.15576e16 * 2.0 / (3.0 * sqrt(0.6911)) * asinh(sqrt(0.6911 / 0.3089) * pow(a, 1.5)) as age,
  3.0856775814913673e19 / 67.74 / 3.15576e16 * 2.0 / (3.0 * sqrt(0.6911)) * asinh(sqrt(0.6911 / 0.3089)) as now from a)
select o_orderkey, round(z, 7) as z, round(age, 6) as age_gyr, round(now - age, 6) as lookback_gyr from t""")
def snapshot_grid(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", (1.0 / (1.0 + F.col("o_totalprice") / 100000.0)).alias("a"))
    age, now = cosmology.age_gyr("a", 67.74, 0.3089), cosmology.age_gyr(F.lit(1.0), 67.74, 0.3089)
    return a.select("o_orderkey", F.round(1 / F.col("a") - 1, 7).alias("z"), F.round(age, 6).alias("age_gyr"), F.round(now - age, 6).alias("lookback_gyr"))


@query("snapshot_gaps", """
with s as (select c_nationkey as snap, 1.0 / (1.0 + c_nationkey * 0.05) as a from customer group by c_nationkey),
t as (select snap, a, 3.0856775814913673e19 / 67.74 / 3.15576e16 * 2.0 / (3.0 * sqrt(0.6911)) * asinh(sqrt(0.6911 / 0.3089) * pow(a, 1.5)) as age from s)
select snap, round(age, 6) as age_gyr, round(lag(age) over (order by snap) - age, 6) as gap_gyr from t""")
def snapshot_gaps(spark, sf):
    s = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("snap")).agg((1.0 / (1.0 + F.max("c_nationkey") * 0.05)).alias("a"))
    t = s.withColumn("age_gyr", cosmology.age_gyr("a", 67.74, 0.3089))
    w = Window.orderBy("snap")  # one row per snapshot
    return _r(t.withColumn("gap_gyr", F.lag("age_gyr").over(w) - F.col("age_gyr")).drop("a"), 6, "age_gyr", "gap_gyr")


@query("heap_tree_distance", """
with recursive p as (select o_orderkey, o_orderkey + 1 as a, o_custkey + 1 as b, 0 as d from orders
 union all select o_orderkey, case when a > b then a // 2 else a end, case when b > a then b // 2 else b end, d + 1 from p where a <> b)
select o_orderkey, max(d)::INT as dist from p group by 1""")
def heap_tree_distance(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalars.heap_distance("o_orderkey", "o_custkey").alias("dist"))


@query("safe_log10", "select o_orderkey, case when o_totalprice > 250000 then round(log10(o_totalprice - 250000), 6) end as lg from orders")
def safe_log10(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(scalars.safe_log10(F.col("o_totalprice") - 250000), 6).alias("lg"))


@query("relative_residual", f"select l_returnflag, round(avg({_RES}), 6) as mean_dz from lineitem group by 1")
def relative_residual(spark, sf):
    dz = scalars.relative_residual(F.col("l_extendedprice") / 40000.0, F.col("l_quantity") / 25.0)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(dz), 6).alias("mean_dz"))


@query("ranks_null_group", """
with r as (select o_orderkey, case when o_orderpriority = '5-LOW' then null else o_orderpriority end as g, case when o_orderkey % 11 = 0 then null else floor(o_totalprice / 1000) end as x from orders),
k as (select o_orderkey, g, x, rank() over (partition by g, x is null order by x) + (count(*) over (partition by g, x) - 1) / 2.0::DOUBLE as a from r)
select o_orderkey, g, case when x is not null then a end as avg_rank from k""")
def ranks_null_group(spark, sf):
    """Rows without a group are ranked among themselves; rows without a value have no rank."""
    o = table(spark, sf, "orders")
    o = o.select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("g"), F.when(F.col("o_orderkey") % 11 != 0, F.floor(F.col("o_totalprice") / 1000).cast("double")).alias("x"))
    return ranking.with_average_rank(o, "x", "avg_rank", ["g"]).select("o_orderkey", "g", "avg_rank")


@query("quantiles_with_nan", """
with r as (select case when o_orderpriority = '5-LOW' then null else o_orderpriority end as g, case when o_orderkey % 13 = 0 then 'nan'::DOUBLE when o_orderkey % 7 = 0 then null else o_totalprice end as x from orders)
select g, round(quantile_cont(x, 0.25), 6) as q0, round(quantile_cont(x, 0.5), 6) as q1, quantile_disc(x, 1.0) as q2 from r group by 1""")
def quantiles_with_nan(spark, sf):
    """NaN ranks above every number, NULL is left out, and NULL group keys are a group."""
    o = table(spark, sf, "orders")
    x = F.when(F.col("o_orderkey") % 13 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    o = o.select(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("g"), x.alias("x"))
    q = ranking.quantiles(o, "x", [0.25, 0.5, 1.0], ["g"])
    return q.select("g", F.round("q0", 6).alias("q0"), F.round("q1", 6).alias("q1"), "q2")
