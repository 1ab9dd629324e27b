"""Functions that Spark doesn't have."""

from __future__ import annotations

from math import erfc, exp, pi, sqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-square with dof degrees of freedom > x), by the finite sums for even and odd dof."""
    if x <= 0:
        return 1.0
    half = x / 2
    if dof % 2 == 0:
        term = total = exp(-half)
        for i in range(1, dof // 2):
            term *= half / i
            total += term
        return min(1.0, total)
    total, term = erfc(sqrt(half)), exp(-half) * sqrt(half) * 2 / sqrt(pi)
    for i in range(1, dof, 2):
        total += term
        term *= x / (i + 2)
    return min(1.0, total)


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    """H1. At most one row a field, so its cost doesn't grow with the data."""
    return pd.Series([None if pd.isna(a) or pd.isna(k) or k < 1 else chi2_tail(float(a), int(k)) for a, k in zip(x, dof, strict=True)], dtype="float64")


def guarded_corr(x: Column, y: Column, least_std: float = 0.0) -> Column:
    """Pearson r of rows where both are known; null for a constant side."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    sx, sy = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sx > least_std) & (sy > least_std), F.covar_pop(a, b) / F.nullif(sx * sy, F.lit(0.0)))


def bins_below(edges: Column, x: Column, strict: bool = True) -> Column:
    """How many edges are below x (strict) or not above it."""
    return F.size(F.filter(edges, (lambda e: e < x) if strict else (lambda e: e <= x)))
