"""Student's t quantile for two-sided 95% intervals, with fractional degrees of freedom."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054
#: From this many degrees of freedom the expansion is used.
LARGE = 200.0


def expansion(v):
    """Asymptotic expansion in 1/v to the fourth order (Abramowitz and Stegun 26.7.5); v may be a number or a Column."""
    z = Z
    return (
        z
        + (z**3 + z) / (4 * v)
        + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v * v * v)
        + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * v * v * v * v)
    )


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    result = d
    for m in range(1, 400):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + up * d or tiny)
            c = 1 + up / c or tiny
            result *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * result / a


def critical(v: float | None) -> float | None:
    """t with P(|T| <= t) = 0.95; None for v that is missing or not positive."""
    if v is None or not v > 0:
        return None
    if v >= LARGE:
        return expansion(v)
    low, high = 0.0, 1.0
    outside = lambda t: _incomplete_beta(v / 2, 0.5, v / (v + t * t))
    while outside(high) > 0.05 and high < 1e300:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if outside(middle) > 0.05 else (low, middle)
    return (low + high) / 2


def critical_column(v: Column) -> Column:
    """For grouped estimates: the expansion in the plan, and exact inversion for small degrees of freedom."""

    @F.pandas_udf("double")
    def exact(part: pd.Series) -> pd.Series:
        return part.map(lambda x: critical(None if pd.isna(x) else x)).astype("float64")

    return F.when(v >= LARGE, expansion(v)).when(v > 0, exact(v))
