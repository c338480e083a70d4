"""Student's t in plain Python (for the few rows of a report) and as columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def critical(df: float, confidence: float = 0.95) -> float:
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if two_sided(mid, df) > 1 - confidence else (lo, mid)
    return (lo + hi) / 2


def p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value; null where t or a positive df is missing. Rows here are groups of a report."""

    @F.pandas_udf("double")
    def of(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else two_sided(float(a), float(b)) for a, b in zip(t, df, strict=True)], dtype="float64")

    return of(t, df)


def t_critical(n: Column, confidence: float = 0.95) -> Column:
    """Critical value for the mean of n values; null below two. Rows here are groups of a report."""

    @F.pandas_udf("double")
    def of(n: pd.Series) -> pd.Series:
        known = {int(x): critical(int(x) - 1, confidence) for x in n.dropna().unique() if x > 1}
        return n.map(known).astype("float64")

    return of(n)


def margin(n: Column, sd: Column, confidence: float = 0.95) -> Column:
    """Half width of the mean's confidence interval; 0 for fewer than two values."""
    return F.when(n < 2, F.lit(0.0)).otherwise(t_critical(n, confidence=confidence) * sd / F.sqrt(n.cast("double")))
