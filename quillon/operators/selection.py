"""Filters, named populations, labels from thresholds and step lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import col, flag
from quillon.operators import ranking


def in_open_range(c, lo: float, hi: float) -> Column:
    x = col(c)
    return flag((x > lo) & (x < hi))


def populations(df: DataFrame, masks: Mapping[str, Column]) -> DataFrame:
    """Named boolean columns; missing inputs count as outside."""
    return df.select("*", *[flag(cond).alias(name) for name, cond in masks.items()])


def population_counts(df: DataFrame, masks: Mapping[str, Column]) -> DataFrame:
    """Rows in each named population, from one pass."""
    one = df.agg(*[F.count_if(flag(cond)).alias(name) for name, cond in masks.items()])
    rows = [F.struct(F.lit(n).alias("population"), F.col(n).alias("n")) for n in masks]
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def two_threshold_label(c, low: float, high: float) -> Column:
    """1 above ``high``, 0 below ``low``, -1 between or missing."""
    x = col(c)
    return F.when(x > high, 1).when(x < low, 0).otherwise(-1)


def code_group(c, code, inside: str, outside: str) -> Column:
    """One code maps to ``inside``; everything else, missing included, to ``outside``."""
    return F.when(col(c).eqNullSafe(F.lit(code)), inside).otherwise(outside)


def step_lookup(c, steps: Mapping[float, str], tolerance: float = 1e-9) -> Column:
    """Label of the largest edge not above the value; below all edges the first label applies."""
    edges = sorted(steps)
    out = F.lit(steps[edges[0]])
    for edge in edges:
        out = F.when(col(c) + tolerance >= edge, F.lit(steps[edge])).otherwise(out)
    return out


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values in several columns become the column's exact median."""
    med = ranking.quantiles_of(df, columns, [0.5], ["median"])
    wide = med.agg(*[F.max(F.when(F.col("metric") == c, F.col("median"))).alias(f"_m_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(wide))  # one row by construction
    return out.select(*[F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])
