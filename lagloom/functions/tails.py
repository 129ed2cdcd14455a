"""Distribution tails in numpy, for columns of statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_tail_whole(t: np.ndarray, df: int) -> np.ndarray:
    """Two-sided tails of many t values with the same whole degrees of freedom, by the finite sums."""
    root = np.sqrt(df + t * t)
    s, c = np.abs(t) / root, math.sqrt(df) / root
    j = np.arange(1, max(1, df // 2 if df % 2 == 0 else (df - 1) // 2))
    ratio = (2 * j - 1) / (2 * j) if df % 2 == 0 else 2 * j / (2 * j + 1)
    terms = np.cumprod(np.concatenate([[1.0], ratio]))
    power = (c[:, None] ** 2) ** np.arange(len(terms))[None, :]
    if df % 2 == 0:
        return np.maximum(0.0, 1 - s * (power @ terms))
    inner = s * c * (power @ terms) if df > 1 else 0.0
    return np.maximum(0.0, 1 - 2 / math.pi * (np.arcsin(s) + inner))


def _each(f, *cols: pd.Series) -> pd.Series:
    return pd.Series([float("nan") if any(x is None or x != x for x in r) else f(*map(float, r)) for r in zip(*cols, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(f_tail, f, d1, d2)


@F.pandas_udf(DoubleType())
def p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_tail, t, df)


def t_tails(t: np.ndarray, df: np.ndarray, most: int = 2000) -> np.ndarray:
    """t_tail of columns to 1e-14 or so: finite sums for all rows of the same whole degrees of freedom, one by one beyond ``most`` and for others."""
    out = np.where(np.isinf(t) & ~np.isnan(df), 0.0, np.nan)
    ok = np.isfinite(t) & ~np.isnan(df)
    for d in np.unique(df[ok]).tolist():
        on = np.flatnonzero(ok & (df == d))
        whole = d == int(d) and 1 <= d <= most
        for part in np.array_split(on, -(-len(on) // 1000)):
            out[part] = t_tail_whole(t[part], int(d)) if whole else [t_tail(x, d) for x in t[part].tolist()]
    return out


@F.pandas_udf(DoubleType())
def p_t_whole(t: pd.Series, df: pd.Series) -> pd.Series:
    """p_t where the absolute error counts: small p keep no relative accuracy."""
    return pd.Series(t_tails(t.to_numpy(np.float64, na_value=np.nan), df.to_numpy(np.float64, na_value=np.nan)))


@F.pandas_udf(DoubleType())
def p_z(z: pd.Series) -> pd.Series:
    return _each(lambda x: math.erfc(abs(x) / math.sqrt(2)), z)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_tail(mid, df) / 2 > 1 - p else (lo, mid)
    return float(np.mean([lo, hi]))
