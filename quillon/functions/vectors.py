"""Row-wise vector expressions on array columns, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.scalars import col


def _fold(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def as_double(v) -> Column:
    return col(v).cast("array<double>")


def dot(a, b) -> Column:
    return _fold(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_fold(F.transform(as_double(a), lambda x: x * x)))


def l2(a, b) -> Column:
    return F.sqrt(_fold(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalise(a, eps: float = 1e-12) -> Column:
    n = norm(a)
    return F.transform(as_double(a), lambda x: x / (n + F.lit(eps)))


def subtract(a, b) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def shift(a, direction, amount) -> Column:
    return F.zip_with(as_double(a), as_double(direction), lambda x, y: x + col(amount) * y)


def has_bad_value(a) -> Column:
    return F.exists(as_double(a), lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def usable(a) -> Column:
    """True for a vector that is there and holds finite numbers only."""
    fine = F.forall(as_double(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))
