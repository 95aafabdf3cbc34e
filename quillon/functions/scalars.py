"""Row-wise scalar functions. Each takes and returns Columns and stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """The value as double when it is a finite number, else NULL."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def clean(c, floor: float | None = None, bounds: tuple[float, float] | None = None) -> Column:
    """Missing-value rule: non-finite, not above ``floor``, or outside ``bounds`` becomes NULL."""
    x = finite(c)
    keep = x.isNotNull()
    if floor is not None:
        keep = keep & (x > floor)
    if bounds is not None:
        keep = keep & x.between(*bounds)
    return F.when(keep, x)


def flag(cond: Column) -> Column:
    """Boolean that is false, not NULL, when an input is missing."""
    return F.coalesce(cond, F.lit(False))


def mag_to_flux(mag, zero_point: float = 22.5) -> Column:
    return F.pow(F.lit(10.0), (F.lit(zero_point) - col(mag)) / 2.5)


def flux_to_mag(flux, zero_point: float = 22.5, floor: float = 1e-9) -> Column:
    return F.lit(zero_point) - 2.5 * F.log10(F.greatest(col(flux), F.lit(floor)))


def colour_index(a, b, offset: float = 0.0) -> Column:
    return col(a) - col(b) + F.lit(offset)


def safe_log10(c) -> Column:
    x = finite(c)
    return F.when(x > 0, F.log10(x))


def relative_residual(predicted, actual) -> Column:
    """(predicted - actual) / (1 + actual)."""
    return (col(predicted) - col(actual)) / (1 + col(actual))


def ellipticity(e1, e2) -> Column:
    return F.hypot(col(e1), col(e2))


def axis_ratio(e1, e2) -> Column:
    e = ellipticity(e1, e2)
    return (1 - e) / (1 + e)


def position_angle(e1, e2) -> Column:
    """Axis direction in degrees, in [0, 180)."""
    return F.pmod(F.degrees(0.5 * F.atan2(col(e2), col(e1))), F.lit(180.0))


def inclination(ba) -> Column:
    """Thin-disc inclination in degrees from an axis ratio."""
    return F.degrees(F.acos(F.least(F.greatest(col(ba), F.lit(0.0)), F.lit(1.0))))


def shape_snr(e1, e2, ivar1, ivar2) -> Column:
    """Ellipticity over the quadrature sum of its component errors."""
    sigma = lambda ivar: 1 / F.sqrt(F.greatest(col(ivar), F.lit(1e-30)))
    return ellipticity(e1, e2) / F.greatest(F.hypot(sigma(ivar1), sigma(ivar2)), F.lit(1e-9))


def flux_colour(flux_a, flux_b, offset: float = 0.64) -> Column:
    """Magnitude difference of two positive fluxes plus a zero-point offset, NULL otherwise."""
    ok = (col(flux_a) > 0) & (col(flux_b) > 0)
    return F.when(ok, 2.5 * F.log10(col(flux_b) / col(flux_a)) + F.lit(offset))


def angle_sigma(e1, e2, ivar1, ivar2) -> Column:
    """Propagated uncertainty of the position angle in degrees, NULL when undefined."""
    e_sq = F.pow(col(e1), 2) + F.pow(col(e2), 2)
    num = F.pow(col(e2), 2) / col(ivar1) + F.pow(col(e1), 2) / col(ivar2)
    ok = (col(ivar1) > 0) & (col(ivar2) > 0) & (e_sq > 0)
    return finite(F.when(ok, F.degrees(0.5 * F.sqrt(num) / e_sq)))


def heap_depth(node) -> Column:
    """Depth of a binary-heap node id counted from zero."""
    return F.length(F.bin(col(node).cast("long") + 1)) - 1


def heap_distance(a, b) -> Column:
    """Path length between two binary-heap node ids: depths minus twice the shared prefix."""
    pa, pb = F.bin(col(a).cast("long") + 1), F.bin(col(b).cast("long") + 1)
    shared = F.aggregate(
        F.sequence(F.lit(1), F.least(F.length(pa), F.length(pb))),
        F.lit(0),
        lambda acc, i: F.when(F.left(pa, i) == F.left(pb, i), i).otherwise(acc),
    )
    return F.length(pa) + F.length(pb) - 2 * shared
