"""Small numeric helpers for result tables: tail probabilities without external libraries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / (c if abs(c) > tiny else tiny)
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    if not (math.isfinite(t) and dof > 0):
        return float("nan")
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def binomial_two_sided(wins: int, trials: int) -> float:
    """Two-sided sign test against one half."""
    if trials <= 0:
        return float("nan")
    tail = min(wins, trials - wins)
    # P(X <= tail) for Binomial(trials, 1/2) is an incomplete beta value, stable for large counts.
    lower = incomplete_beta(trials - tail, tail + 1, 0.5)
    return min(1.0, 2.0 * lower)


def t_pvalue(t, dof):
    """Column form of the scalar function, for result tables."""

    def many(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(float(a), float(b)) for a, b in zip(x, y)], dtype="float64")

    return F.pandas_udf(many, "double")(t, dof)


def sign_test_pvalue(wins, trials):
    """Column form of the scalar function, for result tables."""

    def many(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([binomial_two_sided(int(a), int(b)) for a, b in zip(x, y)], dtype="float64")

    return F.pandas_udf(many, "double")(wins, trials)


def kolmogorov_tail(d: float, n: int) -> float:
    """Asymptotic Kolmogorov tail with the usual small-sample correction of the argument."""
    if n <= 0:
        return float("nan")
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if lam < 0.2:
        return 1.0
    j = np.arange(1, 101)
    return float(np.clip(2.0 * np.sum((-1.0) ** (j - 1) * np.exp(-2.0 * (j * lam) ** 2)), 0.0, 1.0))


def ks_pvalue(d, n):
    """Column form of the scalar function, for result tables."""

    def many(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([kolmogorov_tail(float(a), int(b)) for a, b in zip(x, y)], dtype="float64")

    return F.pandas_udf(many, "double")(d, n)


def gamma_quantile(p: float, shape: float) -> float:
    """Quantile of Gamma(shape, 1) by bisection on the regularised lower incomplete gamma."""
    lo, hi = 0.0, shape + 20.0 * math.sqrt(shape) + 50.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if lower_gamma(shape, mid) < p else (lo, mid)
    return 0.5 * (lo + hi)


def lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below the mean, continued fraction above; a normal
    approximation (Wilson-Hilferty) for very large shapes where both become slow."""
    if x <= 0:
        return 0.0
    if a > 1e6:
        z = ((x / a) ** (1.0 / 3.0) - (1.0 - 1.0 / (9.0 * a))) * 3.0 * math.sqrt(a)
        return 0.5 * math.erfc(-z / math.sqrt(2.0))
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return total * front
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 1_000_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return 1.0 - front * h
