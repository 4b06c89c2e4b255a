"""Student-t helpers for the experiment statistics.

The p-values are computed on *aggregated* rows (one per model or model
pair), so a vectorised pandas UDF over a handful of rows is the right tool;
the regularised incomplete beta function is evaluated with its continued
fraction in NumPy (no SciPy in the runtime).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(c) > 1e-300 else 1e-300
        de = d * c
        h *= de
        if abs(de - 1.0) < 3e-16:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or df <= 0 or not math.isfinite(t):
        return float("nan") if t is None or (isinstance(t, float) and math.isnan(t)) else 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_ppf_975(df: float) -> float:
    """Two-sided 95 % critical value by bisection on the CDF."""
    lo, hi = 0.0, 100.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_two_sided_p(mid, df) > 0.05:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def _p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(float(a), float(b)) if pd.notna(a) and pd.notna(b) else np.nan
                      for a, b in zip(t, df)])


@F.pandas_udf(T.DoubleType())
def _tcrit_udf(df: pd.Series) -> pd.Series:
    return pd.Series([t_ppf_975(float(d)) if pd.notna(d) and d > 0 else np.nan for d in df])


def t_p_value(t: Column, df: Column) -> Column:
    return _p_udf(t.cast("double"), df.cast("double"))


def t_critical_975(df: Column) -> Column:
    return _tcrit_udf(df.cast("double"))


def stars(p: Column) -> Column:
    return (F.when(p < 0.001, F.lit("***")).when(p < 0.01, F.lit("**")).when(p < 0.05, F.lit("*"))
             .otherwise(F.lit("ns")))
