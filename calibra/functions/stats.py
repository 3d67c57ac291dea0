"""Distributions that SQL lacks, for results that are already small."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + n * d
            c = 1 + n / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2))).astype("float64")


@F.pandas_udf(DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2))).astype("float64")


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(n) else t_two_sided(x, n) for x, n in zip(t, df, strict=True)], dtype="float64")


def normal_sql(z: str, upper: bool = False) -> str:
    """DuckDB SQL of the two-sided (or upper) normal p of ``z``, by erf's series of positive terms; for |z| up to 20, beyond which p is 0 (or 1)."""
    x = f"greatest(abs(CAST({z} AS DOUBLE)), 1e-300)"
    erf = f"(SELECT sum(exp((2 * n + 1) * ln({x} / sqrt(2.0)) - {x} * {x} / 2 - lgamma(n + 1.5))) FROM range(0, 700) s(n))"
    if upper:
        return f"CASE WHEN {z} > 20 THEN 0.0 WHEN {z} < -20 THEN 1.0 WHEN {z} IS NULL THEN NULL ELSE 0.5 * (1 - sign({z}) * {erf}) END"
    return f"CASE WHEN abs({z}) > 20 THEN 0.0 WHEN {z} IS NULL THEN NULL ELSE 1 - {erf} END"


def student_sql(t: str, df: str) -> str:
    """DuckDB SQL of the two-sided Student p of ``t`` with ``df`` degrees, by the series of the incomplete beta function at t^2 / (df + t^2)."""
    y, b = f"greatest(CAST({t} AS DOUBLE) * {t} / ({df} + CAST({t} AS DOUBLE) * {t}), 1e-300)", f"({df} / 2.0)"
    front = f"exp(0.5 * ln({y}) + {b} * ln(1 - {y}) + lgamma({b} + 0.5) - lgamma(0.5) - lgamma({b})) * 2"
    series = f"(1 + (SELECT sum(exp(lgamma({b} + 1.5 + n) - lgamma({b} + 0.5) - lgamma(n + 2.5) + lgamma(1.5) + (n + 1) * ln({y}))) FROM range(0, 700) s(n)))"
    return f"CASE WHEN abs({t}) > 20 THEN 0.0 WHEN {t} IS NULL THEN NULL ELSE 1 - {front} * {series} END"
