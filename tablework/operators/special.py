"""Chi-square upper tail, applied as an Arrow-batched Pandas UDF to the
(one-row) test result. Regularized upper incomplete gamma
Q(a, x) by series (x < a + 1) or Lentz continued fraction (otherwise)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _gamma_q(a: float, x: float) -> float:
    if x < 0 or a <= 0:
        return float("nan")
    if x == 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    lg = math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        ap = a
        while True:                           # converges; more terms for larger a
            ap += 1
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - lg))
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    i = 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - lg) * h


def chi2_survival(stat: float, dof: float) -> float:
    if stat is None or dof is None or dof <= 0 or math.isnan(stat):
        return float("nan")
    return _gamma_q(dof / 2.0, stat / 2.0)


@F.pandas_udf(T.DoubleType())
def _chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_survival(s, d) if pd.notna(s) and pd.notna(d) else None
                      for s, d in zip(stat, dof)], dtype="float64")


def chi2_sf(stat: Column, dof: Column) -> Column:
    """P(X > stat) for X ~ chi-square(dof)."""
    return _chi2_sf(stat.cast("double"), dof.cast("double"))
