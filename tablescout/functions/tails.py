"""Tail probabilities of the t, F and chi-square laws, for rows that are already aggregated."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_EPS = 1e-15


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by Lentz's method."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 20_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + term / c
            c = c if abs(c) > _TINY else _TINY
            value *= c * d
        if abs(c * d - 1.0) < _EPS:
            return value
    return math.nan


def _gamma_step(a: float, b: float) -> float:
    """lgamma(a + b) - lgamma(a); for a large a by its series, as the difference of two large numbers has few digits."""
    if a < 1e5 or b * b > a / 100:
        return math.lgamma(a + b) - math.lgamma(a)
    return b * math.log(a) + b * (b - 1) / (2 * a) - b * (b - 1) * (2 * b - 1) / (12 * a * a)


def incomplete_beta(x: float, a: float, b: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function I_x(a, b); ``rest`` is 1 - x where the caller knows more of its digits."""
    rest = 1.0 - x if rest is None else rest
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    log_x = math.log(x) if x < 0.5 else math.log1p(-rest)
    log_front = _gamma_step(max(a, b), min(a, b)) - math.lgamma(min(a, b)) + a * log_x + b * math.log(rest)
    # With x close to 1 the first fraction is made of differences from 1; near its mean the second has more digits.
    if x < (a + 1.0) / (a + b + 2.0) and (a < 1e5 or rest > 4.0 * (b + 1.0) / (a + b + 2.0)):
        return math.exp(log_front) * _beta_fraction(x, a, b) / a
    return max(0.0, 1.0 - math.exp(log_front) * _beta_fraction(rest, b, a) / b)


def upper_gamma(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(s, x)."""
    if x <= 0.0:
        return 1.0
    log_front = s * math.log(x) - x - math.lgamma(s)
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while term > total * _EPS:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    b = x + 1.0 - s
    c, d = 1.0 / _TINY, 1.0 / b
    value = d
    for i in range(1, 20_000):
        step = -i * (i - s)
        b += 2.0
        d = step * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + step / c
        c = c if abs(c) > _TINY else _TINY
        value *= c * d
        if abs(c * d - 1.0) < _EPS:
            return value * math.exp(log_front)
    return math.nan


def t_tail(t: float, dof: float) -> float:
    return incomplete_beta(dof / (dof + t * t), dof / 2.0, 0.5, t * t / (dof + t * t))


def f_tail(stat: float, d1: float, d2: float) -> float:
    if math.isinf(stat):
        return 0.0
    return incomplete_beta(d2 / (d2 + d1 * stat), d2 / 2.0, d1 / 2.0, d1 * stat / (d2 + d1 * stat))


def chi2_tail(stat: float, dof: float) -> float:
    return 1.0 if dof == 0 else upper_gamma(dof / 2.0, stat / 2.0)


def _rowwise(function, *columns: pd.Series) -> pd.Series:
    rows = zip(*columns)
    return pd.Series([None if any(pd.isna(v) for v in row) else function(*row) for row in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _rowwise(t_tail, t, dof)


@F.pandas_udf(T.DoubleType())
def f_upper(stat: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _rowwise(f_tail, stat, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_upper(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return _rowwise(chi2_tail, stat, dof)


def slope_p_value(r, n):
    """Two-sided p of a least-squares slope from its correlation and the number of pairs."""
    r, n = F.col(r), F.col(n).cast("double")
    spread = (1 - r) * (1 + r)
    t = F.when(spread > 0, r * F.sqrt((n - 2) / F.when(spread > 0, spread)))
    return F.when(spread <= 0, F.lit(0.0)).otherwise(t_two_sided(t, n - 2))
