"""Circular and axial arithmetic in degrees, sky positions and periodic boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.scalars import col


def axial_wrap(c) -> Column:
    """Wrap to [-90, 90)."""
    return F.pmod(col(c) + 90.0, F.lit(180.0)) - 90.0


def circular_error(predicted_rad, actual_rad, k: int = 1) -> Column:
    """Absolute angular error in degrees on the period 360/k; inputs are k-fold angles in radians."""
    d = col(predicted_rad) - col(actual_rad)
    return F.degrees(F.abs(F.atan2(F.sin(d), F.cos(d)))) / k


def chance_floor(k: int) -> Column:
    """Median error of random guesses on the period 360/k."""
    return F.lit(90.0 / k)


def unit_vector(ra_deg, dec_deg) -> list[Column]:
    ra, dec = F.radians(col(ra_deg)), F.radians(col(dec_deg))
    return [F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)]


def chord_to_arcsec(chord) -> Column:
    return F.degrees(2 * F.asin(F.least(col(chord) / 2, F.lit(1.0)))) * 3600.0


def min_image(d, box: float) -> Column:
    """Shortest periodic displacement; half-even like the array libraries."""
    return col(d) - F.lit(box) * F.rint(col(d) / F.lit(box))
