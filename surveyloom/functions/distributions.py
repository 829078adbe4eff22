"""Tail probabilities for the few rows of a test result.

Spark has no t or F distribution; both follow from the regularised incomplete
beta function. Inputs are aggregated results (one row per test), never data rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if not (x > 0):
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Evaluated from the tail inwards with a fixed depth that grows with the parameters.
    depth = 200 + int(5 * math.sqrt(max(a, b)))
    frac = 0.0
    for k in range(depth, 0, -1):
        m = k // 2
        if k % 2 == 0:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        frac = d / (1.0 + frac)
    return front / (1.0 + frac)


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(x) or pd.isna(n) or n <= 0 else incomplete_beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, df)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(x) or b <= 0 else incomplete_beta(b / 2, a / 2, b / (b + a * x)) for x, a, b in zip(f, d1, d2)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)) for x in z], dtype="float64")


def t_two_sided(t: Column, df: Column) -> Column:
    return _t_two_sided(t.cast("double"), df.cast("double"))


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    return _f_upper(f.cast("double"), d1.cast("double"), d2.cast("double"))


def normal_two_sided(z: Column) -> Column:
    return _normal_two_sided(z.cast("double"))
