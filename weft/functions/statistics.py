"""Binomial confidence bounds without external libraries."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            step = c * d
            out *= step
        if abs(step - 1) < 1e-15:
            break
    return front * out


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_cdf(mid, a, b) < p else (lo, mid)
        if hi - lo < 1e-16:
            break
    return (lo + hi) / 2


def clopper_pearson_upper(k: int, n: int, alpha: float = 0.05) -> float:
    """One-sided upper bound of a binomial proportion after k of n."""
    if n <= 0 or not 0 <= k <= n or not 0 < alpha < 1:
        raise ValueError("needs n > 0, 0 <= k <= n, 0 < alpha < 1")
    if k == n:
        return 1.0
    if k == 0:
        return 1 - alpha ** (1 / n)
    return beta_quantile(1 - alpha, k + 1, n - k)


def clopper_pearson_upper_col(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """Closed forms in the JVM, the quantile by Arrow batches."""

    @F.pandas_udf("double")
    def bound(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([clopper_pearson_upper(int(a), int(b), alpha) for a, b in zip(k, n)])

    return F.when(k == n, F.lit(1.0)).when(k == 0, 1 - F.pow(F.lit(alpha), 1 / n)).otherwise(bound(k, n))
