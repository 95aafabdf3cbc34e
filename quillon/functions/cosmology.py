"""Flat matter-plus-constant model: ages in closed form, distances on a fixed-redshift grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import col

# Speed of light in km/s, kilometres per megaparsec and seconds per gigayear.
LIGHT_KM_S = 299792.458
KM_PER_MPC = 3.0856775814913673e19
SEC_PER_GYR = 3.15576e16


def hubble_time_gyr(h0: float) -> float:
    return KM_PER_MPC / h0 / SEC_PER_GYR


def age_gyr(scale_factor, h0: float, omega_m: float) -> Column:
    """Age at a scale factor: 2/(3 sqrt(OL)) asinh(sqrt(OL/OM) a^1.5) Hubble times."""
    ol = 1.0 - omega_m
    front = hubble_time_gyr(h0) * 2.0 / (3.0 * math.sqrt(ol))
    return F.lit(front) * F.asinh(F.lit(math.sqrt(ol / omega_m)) * F.pow(col(scale_factor), 1.5))


def hubble_ratio(z, omega_m: float) -> Column:
    return F.sqrt(F.lit(omega_m) * F.pow(1 + col(z), 3) + F.lit(1.0 - omega_m))


def distance_grid(spark: SparkSession, h0: float, omega_m: float, z_max: float, steps: int) -> DataFrame:
    """Comoving distance at steps+1 equal redshift nodes by the cumulative trapezoid.

    The grid is a parameter of the function (``steps`` rows), not of the data, so one window over it and a
    broadcast of it stay bounded whatever the size of the table it is looked up from.
    """
    dz = z_max / steps
    grid = spark.range(steps + 1).select(F.col("id").alias("node"), (F.col("id") * F.lit(dz)).alias("z_node"))
    grid = grid.withColumn("f", 1 / hubble_ratio("z_node", omega_m))
    order = Window.orderBy("node")
    step = F.coalesce(0.5 * (F.col("f") + F.lag("f").over(order)) * F.lit(dz), F.lit(0.0))
    return (
        grid.withColumn("part", step)
        .withColumn("dc_mpc", F.lit(LIGHT_KM_S / h0) * F.sum("part").over(order))
        .select("node", "z_node", "dc_mpc")
    )


def distance_modulus(z, dc_mpc) -> Column:
    return 5 * F.log10(F.greatest((1 + col(z)) * col(dc_mpc), F.lit(1e-6)) * 1e5)
