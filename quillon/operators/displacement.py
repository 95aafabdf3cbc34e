"""How far transformed versions of a vector table move it, compared pool by pool."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors
from quillon.operators import profiles, ranking


def _joined(base: DataFrame, tables: Mapping[str, DataFrame], key: str, vec: str) -> DataFrame:
    out = base.withColumnRenamed(vec, "_o")
    for name, t in tables.items():
        out = out.join(t.select(key, F.col(vec).alias(f"_{name}")), key)
    return out


def displacements(base: DataFrame, tables: Mapping[str, DataFrame], key: str, vec: str, keep: list[str]) -> DataFrame:
    """Lengths per row: original to flipped, control to flipped, original to control, original to the repeated control."""
    j = _joined(base, tables, key, vec)
    return j.select(
        key, *keep, vectors.l2("_o", "_flip").alias("spec"), vectors.l2("_sandwich", "_flip").alias("pure"),
        vectors.l2("_o", "_sandwich").alias("resamp"), vectors.l2("_o", "_twice").alias("twice"),
    )


def displacement_budget(base: DataFrame, tables: Mapping[str, DataFrame], key: str, vec: str, pool: str) -> DataFrame:
    """Medians per pool, the repeated-over-single ratio, and the size relative to two independent draws."""
    d = displacements(base, tables, key, vec, [pool])
    kinds = ["spec", "pure", "resamp", "twice"]
    long = d.select(pool, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("len")) for k in kinds])).alias("p")).select(pool, "p.kind", "p.len")
    q = ranking.quantiles(long, "len", [0.5], [pool, "kind"], names=["m"])
    wide = q.groupBy(pool).agg(*[F.max(F.when(F.col("kind") == k, F.col("m"))).alias(k) for k in kinds])
    return wide.select(
        pool, "spec", "pure", "resamp", (F.col("twice") / F.col("resamp")).alias("twice_over_once"),
        (F.col("pure") / (F.lit(math.sqrt(2.0)) * F.col("resamp"))).alias("pure_over_prediction"),
    )


def graded_by_attribute(displaced: DataFrame, length: str, attribute: str, edges: list[float], min_rows: int = 50) -> DataFrame:
    """Median displacement in bins of an attribute."""
    return profiles.binned_profile(displaced, profiles.edge_bin(attribute, edges), length, {"median": 0.5}, min_rows=min_rows)
