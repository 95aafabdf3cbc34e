"""Queries for sources, sinks and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import hashing, scalars
from quillon.plans.registry import h32, query, uni
from quillon.runtime import table
from quillon.sources import census, readers, writers


@query("scan_project", "select l_orderkey, l_extendedprice, l_discount from lineitem where l_discount > 0.05")
def scan_project(spark, sf):
    df = readers.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_extendedprice", "l_discount"])
    return df.where(F.col("l_discount") > 0.05)


@query("csv_positions", f"""
select c_custkey as id, round({uni(3, 'c_custkey')} * 360.0, 6) as ra,
       round(degrees(asin(2.0 * {uni(4, 'c_custkey')} - 1.0)), 6) as dec from customer""")
def csv_positions(spark, sf):
    """Positions written as delimited text by Spark, then scanned with a declared schema."""
    pos = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.round(hashing.uniform(3, "c_custkey") * 360.0, 6).alias("ra"),
        F.round(F.degrees(F.asin(2.0 * hashing.uniform(4, "c_custkey") - 1.0)), 6).alias("dec"),
    )
    path = readers.scratch_path(spark, "positions")
    pos.write.option("header", True).csv(path)
    return readers.scan_csv(spark, path, "id long, ra double, dec double")


@query("aligned_set", """
select v.vec_id, v.label, c.c_acctbal, o.n_orders
from embeddings v left join customer c on c.c_custkey = v.vec_id
left join (select o_custkey, count(*)::BIGINT as n_orders from orders group by 1) o on o.o_custkey = v.vec_id""")
def aligned_set(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "label")
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("vec_id"), "c_acctbal")
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("vec_id")).agg(F.count(F.lit(1)).alias("n_orders"))
    return readers.aligned_set(emb, "vec_id", [cust, orders])


@query("write_with_units", """
select o_orderkey, o_totalprice, 'currency' as price_unit from orders""")
def write_with_units(spark, sf):
    path = readers.scratch_path(spark, "units")
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    writers.write_table(df, path, {"o_totalprice": "currency"})
    back = spark.read.parquet(path)
    return back.withColumn("price_unit", F.lit(writers.read_units(back)["o_totalprice"]))


@query("write_json_result", """
with a as (select l_returnflag, count(*)::DOUBLE as n, round(avg(l_quantity), 6) as mean_quantity from lineitem group by 1)
select l_returnflag, metric, value from (
  select l_returnflag, 'n' as metric, n as value from a
  union all select l_returnflag, 'mean_quantity', mean_quantity from a)""")
def write_json_result(spark, sf):
    path = readers.scratch_path(spark, "result")
    agg = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity")
    )
    writers.write_json(agg, path, ["l_returnflag"])
    return spark.read.schema("l_returnflag string, metric string, value double").json(path)


@query("first_readable_source", "select s_suppkey, s_acctbal from supplier")
def first_readable_source(spark, sf):
    return readers.first_readable(spark, [f"{sf}/absent.parquet", f"{sf}/supplier.parquet"]).select("s_suppkey", "s_acctbal")


@query("catalogue_extract", """
select vec_id, label, round(embedding[1]::DOUBLE * 250.0, 6) as pos_x, round(embedding[2]::DOUBLE * 250.0, 6) as pos_y,
       round(embedding[3]::DOUBLE * 250.0, 6) as pos_z
from embeddings where label >= 2""")
def catalogue_extract(spark, sf):
    df = table(spark, sf, "embeddings")
    out = readers.extract(df, F.col("label") >= 2, ["vec_id", "label"], flatten={"embedding": ["pos_x", "pos_y", "pos_z"]})
    return out.select("vec_id", "label", *[F.round(F.col(c) * 250.0, 6).alias(c) for c in ("pos_x", "pos_y", "pos_z")])


@query("catalogue_extract_scaled", """
select o_orderkey, o_custkey, round(o_totalprice * 0.6774, 6) as o_totalprice from orders where o_totalprice > 100000""")
def catalogue_extract_scaled(spark, sf):
    df = table(spark, sf, "orders")
    out = readers.extract(df, F.col("o_totalprice") > 100000, ["o_orderkey", "o_custkey"], scaled={"o_totalprice": 0.6774})
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("shard_gather", """
with n as (select count(*) as n from orders), s as (select range as shard from range(7)),
b as (select shard::INT as shard, (shard * n // 7) as lo, ((shard + 1) * n // 7) as hi from s, n)
select b.shard, count(o.o_orderkey)::BIGINT as n_rows, count(o.o_orderkey) = 0 as missing
from b left join orders o on o.o_orderkey >= b.lo and o.o_orderkey < b.hi group by b.shard""")
def shard_gather(spark, sf):
    orders = table(spark, sf, "orders")
    path = readers.scratch_path(spark, "shards")
    sharded = orders.withColumn("shard", readers.shard_of("o_orderkey", orders.count(), 7))
    writers.write_chunks(sharded, path, "shard")
    return readers.gather_shards(spark, path, "shard", 7)[1]


@query("derive_status", """
select vec_id, (case when len(list_filter(embedding, lambda x: x <> 0)) > 0 then 1 else 2 end)::INT as status from embeddings""")
def derive_status(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", readers.status_of("embedding").alias("status"))


@query("schema_census", """
with t as (
  select 'orders' as product, count(*) as n_rows, 6 as n_columns, 'bigint,double,string,timestamp_ntz' as types from orders
  union all select 'events', count(*), 6, 'bigint,double,string,timestamp_ntz' from events
  union all select 'customer', count(*), 5, 'bigint,double,int,string' from customer
  union all select 'nation', count(*), 3, 'int,string' from nation),
m as (
  select 'orders' as product, (select quantile_cont(o_totalprice, 0.5) from orders) as sm
  union all select 'events', (select quantile_cont(value, 0.5) from events)
  union all select 'customer', (select quantile_cont(c_acctbal, 0.5) from customer)
  union all select 'nation', null)
select t.product, t.n_rows::BIGINT as n_rows, t.n_columns::INT as n_columns, t.types, m.sm as sample_median,
  case when m.sm < 0 then 'negative' when m.sm < 10 then 'small' when m.sm >= 10 then 'large' end as convention,
  coalesce((select string_agg(u.product, ',' order by u.product) from t u where u.n_rows = t.n_rows and u.product <> t.product), '') as same_rows
from t join m on t.product = m.product""")
def schema_census(spark, sf):
    names = ["orders", "events", "customer", "nation"]
    tables = {n: table(spark, sf, n) for n in names}
    probe = {"orders": "o_totalprice", "events": "value", "customer": "c_acctbal"}
    return census.census(tables, probe)


@query("schema_diff", """
with n as (select (select count(*) from customer) as c, (select count(*) from supplier) as s)
select col as "column", lt as left_type, rt as right_type, case when lt is null then null else n.c end::BIGINT as left_rows,
  case when rt is null then null else n.s end::BIGINT as right_rows,
  case when rt is null then 'only_left' when lt is null then 'only_right' when lt <> rt then 'type_differs' when n.c <> n.s then 'rows_differ' else 'same' end as verdict
from n, (values ('key','bigint','bigint'), ('name','string','string'), ('nation','int','int'), ('balance','double','double'), ('segment','string',null)) v(col, lt, rt)""")
def schema_diff(spark, sf):
    cust = table(spark, sf, "customer").toDF("key", "name", "nation", "balance", "segment")
    supp = table(spark, sf, "supplier").toDF("key", "name", "nation", "balance")
    return census.schema_diff(cust, supp)


@query("resolve_columns", "select s_suppkey as id, s_acctbal as mass, cast(null as double) as redshift from supplier")
def resolve_columns(spark, sf):
    candidates = {"id": ["OBJID", "S_SUPPKEY"], "mass": ["LOGMASS", "S_ACCTBAL"], "redshift": ["Z_BEST", "Z"]}
    return readers.select_resolved(table(spark, sf, "supplier"), candidates, required=["id", "mass"])


@query("fingerprint_verify", """
select unnest(['customer', 'nation', 'orders', 'supplier']) as product, unnest(['ok', 'new', 'ok', 'changed']) as status""")
def fingerprint_verify(spark, sf):
    """A manifest is stored, one table changes by a single row and one is added; the check names both."""
    stored = census.fingerprints({n: table(spark, sf, n) for n in ("customer", "orders", "supplier")})
    path = readers.scratch_path(spark, "manifest")
    stored.write.parquet(path)
    supp = table(spark, sf, "supplier")
    changed = supp.withColumn("s_acctbal", F.when(F.col("s_suppkey") == 0, -F.col("s_acctbal")).otherwise(F.col("s_acctbal")))
    now = {"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders").orderBy("o_totalprice"),
           "supplier": changed, "nation": table(spark, sf, "nation")}
    return census.verify_fingerprints(census.fingerprints(now), spark.read.parquet(path))


@query("sentinel_profile", f"""
with s as (select case when {h32(11, 'o_orderkey')} % 10 = 0 then -99.0 when {h32(11, 'o_orderkey')} % 10 = 1 then 'NaN'::DOUBLE
                       else o_totalprice end as rate,
                  case when o_orderstatus = 'F' then -9999.0 else o_totalprice / 1000.0 end as depth from orders),
p as (
select 'rate' as "column", count_if(not isnan(rate) and not isinf(rate))::BIGINT as n_finite, count_if(not isnan(rate) and rate > -98)::BIGINT as n_valid,
  count_if(rate = 0)::BIGINT as n_zero, count(*) as n from s
union all select 'depth', count_if(not isnan(depth))::BIGINT, count_if(depth > -9000)::BIGINT, count_if(depth = 0)::BIGINT, count(*) from s)
select "column", n_finite, n_valid, n_finite - n_valid as n_sentinel, n_zero, round(n_valid / n, 6) as coverage from p""")
def sentinel_profile(spark, sf):
    return census.column_profile(_sentinels(spark, sf), {"rate": -98.0, "depth": -9000.0}).withColumn("coverage", F.round("coverage", 6))


def _sentinels(spark, sf):
    h = hashing.hash32(11, "o_orderkey") % 10
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.when(h == 0, F.lit(-99.0)).when(h == 1, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("rate"),
        F.when(F.col("o_orderstatus") == "F", F.lit(-9999.0)).otherwise(F.col("o_totalprice") / 1000.0).alias("depth"),
    )


@query("sentinel_by_group", """
select o_orderstatus, count_if(o_orderstatus = 'F')::BIGINT as n_sentinel, count(*)::BIGINT as n_rows from orders group by 1""")
def sentinel_by_group(spark, sf):
    return _sentinels(spark, sf).groupBy("o_orderstatus").agg(
        F.count_if(F.col("depth") <= -9000).alias("n_sentinel"), F.count(F.lit(1)).alias("n_rows")
    )


@query("describe_columns", """
with x as (select 'l_quantity' as metric, l_quantity as v from lineitem union all select 'l_extendedprice', l_extendedprice from lineitem)
select metric, count(v)::BIGINT as n_finite, min(v) as min, max(v) as max, round(quantile_cont(v, 0.01), 6) as p1,
  round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.99), 6) as p99 from x group by 1""")
def describe_columns(spark, sf):
    d = census.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return d.select("metric", "n_finite", "min", "max", *[F.round(p, 6).alias(p) for p in ("p1", "p50", "p99")])


@query("clean_values", f"""
with s as (select o_orderkey, {h32(11, 'o_orderkey')} % 10 as h, o_totalprice, o_orderstatus from orders)
select o_orderkey, case when h in (0, 1) then null else o_totalprice end as rate,
  case when o_orderstatus = 'F' or o_totalprice / 1000.0 not between 50 and 400 then null else round(o_totalprice / 1000.0, 6) end as depth from s""")
def clean_values(spark, sf):
    s = _sentinels(spark, sf)
    return s.select("o_orderkey", scalars.clean("rate", floor=-98.0).alias("rate"),
                    F.round(scalars.clean("depth", bounds=(50.0, 400.0)), 6).alias("depth"))
