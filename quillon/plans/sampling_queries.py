"""Queries for matching, sampling and linking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import hashing, vectors
from quillon.operators import linking, matching, profiles, ranking, sampling, vector_stats as V
from quillon.plans import bindings as B
from quillon.plans.registry import h32, query, uni
from quillon.plans.vectors_queries import emb, transformed, zemb
from quillon.runtime import cut_lineage, table


def _r(df, digits, *cols):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("greedy_match")
def greedy_match(spark, sf):
    z = zemb(spark, sf).select("vec_id", F.slice("v", 1, 3).alias("f"), "label").withColumn("pri", vectors.norm("f"))
    z = cut_lineage(z)
    return matching.greedy_match(z.where(F.col("label") < 3), z.where(F.col("label") >= 5), "vec_id", "f", "pri")


@query("matched_contrast")
def matched_contrast(spark, sf):
    pairs = cut_lineage(greedy_match(spark, sf))
    d = V.paired_difference(transformed(spark, sf, "sandwich"), transformed(spark, sf, "flip"), "vec_id", "v").select("vec_id", vectors.norm("diff").alias("len"))
    return matching.contrast_summary(cut_lineage(matching.pair_contrast(pairs, d, "vec_id", "len")), 100, 100)


@query("matched_balance")
def matched_balance(spark, sf):
    pairs = cut_lineage(greedy_match(spark, sf))
    z = zemb(spark, sf).select("vec_id", *[F.col("v")[i].alias(f"f{i}") for i in range(3)])
    return matching.balance(pairs, cut_lineage(z), "vec_id", ["f0", "f1", "f2"])


@query("stratified_draw", f"""
select o_orderkey, bin::INT as bin from (select o_orderkey, floor(o_totalprice / 100000) as bin, row_number() over (partition by floor(o_totalprice / 100000) order by {h32(3, 'o_orderkey')}, o_orderkey) as r from orders) where r <= 40""")
def stratified_draw(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 100000).cast("int").alias("bin"))
    return sampling.quota_draw(o, "o_orderkey", "bin", 40, 3)


_QUOTA = {"P": 600, "O": 500, "F": 900}
_STEP = lambda s, q, prev: f"""{s} as (select o_orderkey, o_custkey, o_orderstatus from orders where o_orderstatus = '{s.upper()}'{prev} order by {h32(8, 'o_orderkey')}, o_orderkey limit {q})"""
_CHAIN = "with " + ", ".join([
    _STEP("p", 600, ""), _STEP("o", 500, " and o_custkey not in (select o_custkey from p)"),
    _STEP("f", 900, " and o_custkey not in (select o_custkey from p) and o_custkey not in (select o_custkey from o)"),
])


def _one_entry(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return sampling.one_entry_draw(o, "o_orderkey", "o_orderstatus", "o_custkey", _QUOTA, ["P", "O", "F"], 8)


@query("one_entry_draw", _CHAIN + " select * from p union all select * from o union all select * from f")
def one_entry_draw(spark, sf):
    return _one_entry(spark, sf)[0]


@query("starvation_report", _CHAIN + f""",
n as (select 'P' as s, 600 as quota, (select count(*) from p) as got union all select 'O', 500, (select count(*) from o) union all select 'F', 900, (select count(*) from f)),
a as (select 'P' as s, count(*) as av from orders where o_orderstatus = 'P' union all select 'O', count(*) from orders where o_orderstatus = 'O' and o_custkey not in (select o_custkey from p)
  union all select 'F', count(*) from orders where o_orderstatus = 'F' and o_custkey not in (select o_custkey from p) and o_custkey not in (select o_custkey from o)),
v as (select s, quota, got, av, 1 - got / quota as st from n join a using (s))
select s as o_orderstatus, quota::BIGINT as quota, av::BIGINT as n_avail, got::BIGINT as n_drawn, round(st, 6) as starvation,
  round(greatest(st - 1.959963984540054 * sqrt(st * (1 - st) / quota), 0), 6) as ci_lo, round(least(st + 1.959963984540054 * sqrt(st * (1 - st) / quota), 1), 6) as ci_hi from v""")
def starvation_report(spark, sf):
    return _r(_one_entry(spark, sf)[1], 6, "starvation", "ci_lo", "ci_hi")


_TGT = """t as (select case when x = 13.0 then 44 else floor((x - 8.5) / 0.1) end::INT as cell, count(*) as n from (select log10(c_acctbal + 1100) + 7.0 as x from customer) where x >= 8.5 and x <= 13.0 group by 1),
q as (select cell, round_even(n * 0.73, 0)::BIGINT as quota from t where round_even(n * 0.73, 0) > 0),
p as (select s_suppkey, floor((log10(s_acctbal + 1100) + 7.0 - 8.5) / 0.1)::INT as cell, row_number() over (partition by floor((log10(s_acctbal + 1100) + 7.0 - 8.5) / 0.1)::INT order by """ + h32(2, "s_suppkey") + """, s_suppkey) as r from supplier)"""


def _hist(spark, sf):
    c = table(spark, sf, "customer").select(F.log10(F.col("c_acctbal") + 1100).alias("m"))
    s = table(spark, sf, "supplier").select("s_suppkey", (F.log10(F.col("s_acctbal") + 1100) + 7.0).alias("m"))
    t = sampling.histogram_target(c, "m", 8.5, 0.1, 45, 0.73, shift=7.0)
    return sampling.histogram_matched_draw(s, "s_suppkey", "m", t, 8.5, 0.1, 2)


@query("hist_match_draw", f"with {_TGT} select s_suppkey, p.cell from p join q using (cell) where r <= quota")
def hist_match_draw(spark, sf):
    return _hist(spark, sf)[0].select("s_suppkey", "cell")


@query("hist_match_starved", f"with {_TGT} select q.cell, q.quota as want, count(p.s_suppkey)::BIGINT as got from q left join p on p.cell = q.cell and p.r <= q.quota group by 1, 2 having count(p.s_suppkey) < q.quota")
def hist_match_starved(spark, sf):
    return _hist(spark, sf)[1]


_VOL = {"1-URGENT": 1.0, "2-HIGH": 2.5, "3-MEDIUM": 4.0}


def _shell_sql(name: str, status: str, used: str) -> str:
    return f"{name} as (select o_orderkey, o_custkey, o_orderpriority, o_totalprice from sel where o_orderpriority = '{status}'{used} order by {h32(6, 'o_orderkey')}, o_orderkey limit (select cap from cap))"


_IMP = "with " + ", ".join([
    "sel as (select o_orderkey, o_custkey, o_orderpriority, o_totalprice from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') and (o_orderpriority <> '1-URGENT' or o_totalprice > 300000))",
    "n as (select o_orderpriority as s, count(*) as n from sel group by 1)",
    "o as (select n, row_number() over (order by n) - 1 as j, coalesce(sum(n) over (order by n rows between unbounded preceding and 1 preceding), 0) as filled, count(*) over () as k, sum(n) over () as everything from n)",
    "cap as (select (case when max(everything) <= 3000 then max(n) else (select min_by((3000 - filled) // (k - j), j) from o where filled + n * (k - j) > 3000) end)::BIGINT as cap from o)",
    _shell_sql("u", "1-URGENT", ""),
    _shell_sql("h", "2-HIGH", " and o_custkey not in (select o_custkey from u)"),
    _shell_sql("m", "3-MEDIUM", " and o_custkey not in (select o_custkey from u) and o_custkey not in (select o_custkey from h)"),
    "d as (select * from u union all select * from h union all select * from m)",
    "w as (select d.*, v.vol * n.n / count(*) over (partition by d.o_orderpriority) as w from d join n on n.s = d.o_orderpriority join (values ('1-URGENT', 1.0::DOUBLE), ('2-HIGH', 2.5), ('3-MEDIUM', 4.0)) v(s, vol) on v.s = d.o_orderpriority)",
    "r as (select *, w / avg(w) over () as weight from w)",
])


@query("importance_draw", _IMP + " select o_orderkey, o_custkey, o_orderpriority, o_totalprice, round(weight, 8) as weight from r")
def importance_draw(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderpriority").isin(*_VOL) & ((F.col("o_orderpriority") != "1-URGENT") | (F.col("o_totalprice") > 300000)))
    o = o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return sampling.importance_draw(o, "o_orderkey", "o_orderpriority", "o_custkey", _VOL, 3000, ["1-URGENT", "2-HIGH", "3-MEDIUM"], 6).withColumn("weight", F.round("weight", 8)).select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "weight")


@query("importance_summary", _IMP + """, f as (select *, floor(o_totalprice / 100000)::INT as bin from r)
select bin, count(*)::BIGINT as n, round(sum(weight * (o_totalprice % 2 < 1)::INT) / sum(weight), 5) as weighted_mean, round(avg((o_totalprice % 2 < 1)::INT), 6) as raw_mean, round(sum(weight) ** 2 / sum(weight * weight), 2) as ess from f group by 1""")
def importance_summary(spark, sf):
    """Weighted and raw class share with the effective sample size per value bin."""
    d = cut_lineage(importance_draw(spark, sf)).withColumn("bin", F.floor(F.col("o_totalprice") / 100000).cast("int"))
    out = profiles.weighted_summary(d, ["bin"], (F.col("o_totalprice") % 2 < 1).cast("double"), "weight")
    return _r(_r(_r(out, 5, "weighted_mean"), 6, "raw_mean"), 2, "ess")


@query("inverse_cdf_draw", f"""
with g as (select l_linenumber as x, count(*)::DOUBLE as f from lineitem group by 1), t as (select x, coalesce(0.5 * (f + lag(f) over (order by x)) * (x - lag(x) over (order by x)), 0) as p from g),
c as (select x, sum(p) over (order by x) / sum(p) over () as cdf from t), s as (select x as x0, cdf as c0, lead(x) over (order by x) as x1, lead(cdf) over (order by x) as c1 from c),
u as (select o_orderkey, {uni(14, 'o_orderkey')} as u from orders)
select o_orderkey, round(x0 + (x1 - x0) * (u - c0) / (c1 - c0), 6) as drawn from u join s on u >= c0 and u < c1""")
def inverse_cdf_draw(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("f"))
    t = sampling.cdf_table(g, "x", "f")
    out = sampling.inverse_cdf_draw(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", t, "x", "drawn", 14)
    return _r(out, 6, "drawn")


@query("volume_weighted_draw")
def volume_weighted_draw(spark, sf):
    """Redshift per row in proportion to shell volume, and the distance modulus at it."""
    t = sampling.cdf_table(sampling.volume_density(spark, 0.075, 0.15, 67.74, 0.3089), "z", "f")
    out = sampling.inverse_cdf_draw(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", t, "z", "z_drawn", 15)
    return out.agg(F.count(F.lit(1)).alias("n"), F.min("z_drawn").alias("lo"), F.avg("z_drawn").alias("mean"), F.max("z_drawn").alias("hi"))


@query("pool_draw", f"""
with p as (select o_totalprice as v, row_number() over (order by {h32('5p', 'o_orderkey')}, o_orderkey) as r from orders where o_orderstatus = 'F'), n as (select count(*) as n from p)
select c.c_custkey, p.v as drawn from customer c, n join p on p.r = floor({uni(5, 'c_custkey')} * n.n) + 1""")
def pool_draw(spark, sf):
    pool = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
    return sampling.pool_draw(table(spark, sf, "customer").select("c_custkey"), "c_custkey", pool, "o_orderkey", "o_totalprice", "drawn", 5)


@query("matching_target", """
with b as (select floor(o_totalprice / 50000)::INT as bin, o_totalprice as v from orders), n as (select count(*) as n from b)
select bin, count(*)::BIGINT as n_real, round_even(count(*) * 5000.0 / any_value(n.n), 0)::BIGINT as quota, round(quantile_cont(v, 0.05), 5) as p5, round(quantile_cont(v, 0.25), 5) as p25, round(quantile_cont(v, 0.5), 5) as p50,
  round(quantile_cont(v, 0.75), 5) as p75, round(quantile_cont(v, 0.95), 5) as p95 from b, n group by 1""")
def matching_target(spark, sf):
    out = sampling.matching_target(table(spark, sf, "orders"), profiles.bin_index("o_totalprice", 0.0, 50000.0), "o_totalprice", 5000)
    return _r(out, 5, "p5", "p25", "p50", "p75", "p95")


@query("deviation_flag", "select l_linenumber, count_if(abs(l_extendedprice - l_quantity * 1400) / (l_quantity * 1400) > 0.2)::BIGINT as flagged, count(*)::BIGINT as n from lineitem group by 1")
def deviation_flag(spark, sf):
    l = table(spark, sf, "lineitem").select("l_linenumber", "l_extendedprice", (F.col("l_quantity") * 1400).alias("b"))
    return sampling.flag_deviation(l, "l_extendedprice", "b", 0.2).groupBy("l_linenumber").agg(F.count_if("mismatch").alias("flagged"), F.count(F.lit(1)).alias("n"))


# ---- linking ------------------------------------------------------------------------------------------------

# Three snapshots of the parts in the periodic box: positions move by 0.5 x velocity per step plus a little noise;
# every seventh part is absent from one snapshot. Link tolerances scaled to this box.
_TOL = [(11.0, 12.0), (10.8, 10.0), (None, 8.0)]
_WIN = [(10.8, 0.35), (None, 0.25)]
_CAL = {"log_mass": 10.5, "max_sep": 40.0, "mass_window": 0.15}


def snapshot(spark, sf, t: int):
    p = table(spark, sf, "part").where((F.col("p_partkey") % 7) != t + 2)
    u = lambda s: hashing.uniform(s, "p_partkey")
    cols = [F.col("p_partkey").alias("id"), (9.0 + 3.0 * u(90) + 0.1 * (u(f"m{t}") - 0.5)).alias("log_mass")]
    for i, c in enumerate(("x", "y", "z")):
        v = (u(80 + i) - 0.5) * 40.0
        cols += [v.alias(f"v{c}"), F.pmod(u(70 + i) * B.BOX + 0.5 * t * v + (u(f"n{t}{c}") - 0.5) * 1.0, F.lit(B.BOX)).alias(c)]
    return p.select(*cols)


def snap_sql(t: int) -> str:
    v = {c: f"({uni(80 + i, 'p_partkey')} - 0.5) * 40.0" for i, c in enumerate("xyz")}
    pos = ", ".join(
        f"((({uni(70 + i, 'p_partkey')} * {B.BOX} + 0.5 * {t} * ({v[c]}) + ({uni(f'n{t}{c}', 'p_partkey')} - 0.5) * 1.0) % {B.BOX}) + {B.BOX}) % {B.BOX} as {c}, {v[c]} as v{c}"
        for i, c in enumerate("xyz")
    )
    return f"(select p_partkey as id, 9.0 + 3.0 * {uni(90, 'p_partkey')} + 0.1 * ({uni(f'm{t}', 'p_partkey')} - 0.5) as log_mass, {pos} from part where p_partkey % 7 <> {t + 2})"


def _mi(e: str) -> str:
    return f"(({e}) - {B.BOX} * round_even(({e}) / {B.BOX}, 0))"


_D2 = " + ".join(f"{_mi(f'b.{c} - a.{c}')} ** 2" for c in "xyz")


@query("link_calibration", f"""
with a as (select * from {snap_sql(0)} where log_mass > 10.5), b as (select * from {snap_sql(1)} where log_mass > 10.5),
d as (select a.id as a_id, b.id as b_id, sqrt({_D2}) as sep from a, b), fa as (select a_id, min((sep, b_id)) as m from d group by 1), fb as (select b_id, min((sep, a_id)) as m from d group by 1),
j as (select a.*, {', '.join(_mi(f'b.{c} - a.{c}') + f' as d{c}' for c in 'xyz')} from fa join fb on fb.b_id = fa.m[2] and fb.m[2] = fa.a_id join a on a.id = fa.a_id join b on b.id = fb.b_id where fa.m[1] < 40 and abs(a.log_mass - b.log_mass) < 0.15),
k as (select count(*) as n, sum(dx * vx + dy * vy + dz * vz) / sum(vx * vx + vy * vy + vz * vz) as k from j)
select any_value(n)::BIGINT as n, round(any_value(k), 6) as k, round(quantile_cont(sqrt(dx * dx + dy * dy + dz * dz), 0.5), 6) as residual_still,
 round(quantile_cont(sqrt((dx - k * vx) ** 2 + (dy - k * vy) ** 2 + (dz - k * vz) ** 2), 0.5), 6) as residual_moved from j, k""")
def link_calibration(spark, sf):
    return _r(linking.calibrate(cut_lineage(snapshot(spark, sf, 0)), cut_lineage(snapshot(spark, sf, 1)), B.BOX, _CAL), 6, "k", "residual_still", "residual_moved")


def _links(spark, sf):
    snaps = {t: cut_lineage(snapshot(spark, sf, t)) for t in range(3)}
    out = None
    for t in (0, 1):
        one = linking.link_pair(snaps[t], snaps[t + 1], B.BOX, 0.5, _TOL, _WIN).withColumns({"a_snap": F.lit(str(t)), "b_snap": F.lit(str(t + 1))})
        out = one if out is None else out.unionByName(one)
    return snaps, cut_lineage(out)


def _link_sql(t: int) -> str:
    moved = ", ".join(f"(((a0.{c} + 0.5 * a0.v{c}) % {B.BOX}) + {B.BOX}) % {B.BOX} as {c}" for c in "xyz")
    return f"""a{t} as (select id, log_mass, {moved} from {snap_sql(t)} a0), b{t} as (select * from {snap_sql(t + 1)}),
d{t} as (select a.id as a_id, b.id as b_id, a.log_mass as ma, b.log_mass as mb, sqrt({_D2}) as sep from a{t} a, b{t} b),
fa{t} as (select a_id, min((sep, b_id)) as m from d{t} group by 1), fb{t} as (select b_id, min((sep, a_id)) as m from d{t} group by 1),
l{t} as (select '{t}' as a_snap, '{t + 1}' as b_snap, d.a_id, d.b_id, d.sep from fa{t} fa join fb{t} fb on fb.b_id = fa.m[2] and fb.m[2] = fa.a_id join d{t} d on d.a_id = fa.a_id and d.b_id = fb.b_id
  where d.sep < case when ma > 11 then 12 when ma > 10.8 then 10 else 8 end and abs(ma - mb) < case when ma > 10.8 then 0.35 else 0.25 end)"""


@query("snapshot_links", f"with {_link_sql(0)}, {_link_sql(1)} select a_snap, b_snap, a_id, b_id, round(sep, 6) as sep from l0 union all select a_snap, b_snap, a_id, b_id, round(sep, 6) from l1")
def snapshot_links(spark, sf):
    return _r(_links(spark, sf)[1].select("a_snap", "b_snap", "a_id", "b_id", "sep"), 6, "sep")


def _chain_rows(spark, sf):
    snaps, links = _links(spark, sf)
    cat = None
    for t, s in snaps.items():
        one = s.select(F.lit(str(t)).alias("snap"), "id", "log_mass")
        cat = one if cat is None else cat.unionByName(one)
    return cut_lineage(linking.chains(cat, links))


_CHAINS = f"""with {_link_sql(0)}, {_link_sql(1)}, cat as (select '0' as snap, id, log_mass from {snap_sql(0)} union all select '1', id, log_mass from {snap_sql(1)} union all select '2', id, log_mass from {snap_sql(2)}),
p as (select cat.*, case when snap = '0' then '0:' || id when snap = '1' then coalesce('0:' || (select a_id from l0 where b_id = cat.id), '1:' || id)
  else coalesce((select coalesce('0:' || z.a_id, '1:' || y.a_id) from l1 y left join l0 z on z.b_id = y.a_id where y.b_id = cat.id), '2:' || id) end as chain from cat),
r as (select *, count(*) over (partition by chain) as chain_len from p)"""


@query("chain_lengths", _CHAINS + " select chain_len::BIGINT as chain_len, count(distinct chain)::BIGINT as n_chains from r group by 1")
def chain_lengths(spark, sf):
    return linking.chain_length_distribution(_chain_rows(spark, sf))


@query("chain_recurrence", _CHAINS + """ select (case when log_mass < 10 then 0 when log_mass < 10.8 then 1 when log_mass < 11.5 then 2 else 3 end)::INT as bin, count(*)::BIGINT as n, round(avg((chain_len >= 2)::INT), 6) as share_in_chain,
 round(avg(chain_len), 6) as mean_length from r where log_mass >= 8 and log_mass < 99 group by 1""")
def chain_recurrence(spark, sf):
    out = linking.recurrence_by_bin(_chain_rows(spark, sf), "log_mass", [8.0, 10.0, 10.8, 11.5, 99.0])
    return _r(out, 6, "share_in_chain", "mean_length")


@query("shared_id_chains", """
with c as (select o_custkey as id, o_orderpriority as snap, max(o_totalprice) as m from orders group by 1, 2),
a as (select id, snap, m, count(*) over (partition by id) as chain_len, case when snap in ('1-URGENT', '2-HIGH') then count(*) filter (snap in ('1-URGENT', '2-HIGH')) over (partition by id) end as pool_len from c)
select chain_len::BIGINT as chain_len, pool_len::BIGINT as pool_len, count(*)::BIGINT as n, round(avg(m), 4) as mean_m from a group by 1, 2""")
def shared_id_chains(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("snap")).agg(F.max("o_totalprice").alias("m"))
    rows = linking.shared_id_chains(cut_lineage(c), "id", "snap", ["1-URGENT", "2-HIGH"])
    return rows.groupBy("chain_len", "pool_len").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 4).alias("mean_m"))
