"""Columns the test tables do not have, derived from their keys by Spark: sky positions, boxes, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import hashing
from quillon.plans.registry import uni
from quillon.runtime import table


def sky_positions(spark, sf, name: str, key: str) -> DataFrame:
    """Uniform positions on the sphere from a table's key."""
    return table(spark, sf, name).select(
        key,
        (hashing.uniform(3, key) * 360.0).alias("ra"),
        F.degrees(F.asin(2.0 * hashing.uniform(4, key) - 1.0)).alias("dec"),
    )


def sky_sql(name: str, key: str) -> str:
    return f"(select {key}, {uni(3, key)} * 360.0 as ra, degrees(asin(2.0 * {uni(4, key)} - 1.0)) as dec from {name})"


BOX = 1000.0


def box_positions(df: DataFrame, key: str, seed: int = 20) -> DataFrame:
    """x, y, z uniform in the periodic box from a key."""
    return df.select("*", *[(hashing.uniform(seed + i, key) * BOX).alias(c) for i, c in enumerate(("x", "y", "z"))])


def box_sql(key: str, seed: int = 20) -> str:
    return ", ".join(f"{uni(seed + i, key)} * {BOX} as {c}" for i, c in enumerate(("x", "y", "z")))


def later_positions(df: DataFrame, key: str, seed: int = 20) -> DataFrame:
    """The same objects displaced by up to 8 per axis, wrapped; every fifth key sits somewhere unrelated."""
    cols = []
    for i, c in enumerate(("x", "y", "z")):
        moved = F.pmod(hashing.uniform(seed + i, key) * BOX + (hashing.uniform(seed + 10 + i, key) - 0.5) * 16.0, F.lit(BOX))
        cols.append(F.when(F.col(key) % 5 == 0, hashing.uniform(seed + 13 + i, key) * BOX).otherwise(moved).alias(c))
    return df.select("*", *cols)


def later_sql(key: str, seed: int = 20) -> str:
    parts = []
    for i, c in enumerate(("x", "y", "z")):
        moved = f"{uni(seed + i, key)} * {BOX} + ({uni(seed + 10 + i, key)} - 0.5) * 16.0"
        parts.append(f"case when {key} % 5 = 0 then {uni(seed + 13 + i, key)} * {BOX} else ((({moved}) % {BOX}) + {BOX}) % {BOX} end as {c}")
    return ", ".join(parts)


# Members (orders) around owners (customers): ten member rows per owner slot, a few of them gaps.
def owners(spark, sf) -> DataFrame:
    c = box_positions(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return c.withColumns({
        "offset": F.col("c_custkey") * 10, "n_rows": 4 + F.col("c_custkey") % 6,
        "radius": F.when(F.col("c_custkey") % 37 == 0, F.lit(0.0)).otherwise(10.0 + F.col("c_custkey") % 50),
    })


def members(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_totalprice").alias("mass"))
    slot = F.floor(F.col("row_idx") / 10)
    cols = {f"p{c}": F.pmod(hashing.uniform(20 + i, slot) * BOX + (hashing.uniform(40 + i, "row_idx") - 0.5) * 120.0, F.lit(BOX)) for i, c in enumerate(("x", "y", "z"))}
    u = hashing.uniform(43, "row_idx")
    return o.withColumns({**cols, "age": 13.0 * u * u * u * u - 0.01, "metal": hashing.uniform(44, "row_idx") * 0.04})


def members_sql() -> str:
    pos = ", ".join(
        f"((({uni(20 + i, 'o_orderkey // 10')} * {BOX} + ({uni(40 + i, 'o_orderkey')} - 0.5) * 120.0) % {BOX}) + {BOX}) % {BOX} as p{c}"
        for i, c in enumerate(("x", "y", "z"))
    )
    u = uni(43, "o_orderkey")
    return f"(select o_orderkey as row_idx, o_totalprice as mass, {pos}, 13.0 * {u} * {u} * {u} * {u} - 0.01 as age, {uni(44, 'o_orderkey')} * 0.04 as metal from orders)"


def owners_sql() -> str:
    return (
        f"(select c_custkey, {box_sql('c_custkey')}, c_custkey * 10 as \"offset\", 4 + c_custkey % 6 as n_rows, "
        "case when c_custkey % 37 = 0 then 0.0 else 10.0 + c_custkey % 50 end as radius from customer)"
    )
