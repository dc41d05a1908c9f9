"""Tail probabilities that Spark has no functions for, on numpy arrays and as vectorised columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (modified Lentz), on the side where that converges fast."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (z > 0) & (z < 1)
    zz = np.where(inside, z, 0.5)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(zz) + q * np.log1p(-zz)) / p if p.size else p
    tiny = 1e-300
    c, d = np.ones_like(zz), 1 - (p + q) * zz / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, rounds):
        for top in (m * (q - m) * zz / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * zz / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            f = f * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    out = np.where(inside, front * f, np.where(z >= 1, 1.0, 0.0))
    return np.where(swap, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|); NaN where either is missing or df is not positive."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    n, x = np.where(ok, df, 1.0), np.where(ok & np.isfinite(t), t, 0.0)
    out = beta_inc(n / 2, np.full_like(n, 0.5), n / (n + x * x))
    return np.where(ok, np.where(np.isinf(t), 0.0, out), np.nan)


def normal_sf(z: np.ndarray) -> np.ndarray:
    """P(Z >= z)."""
    z = np.asarray(z, float)
    return np.where(np.isnan(z), np.nan, 0.5 * _erfc(np.nan_to_num(z) / math.sqrt(2)))


def hypergeom_sf(k: np.ndarray, total: np.ndarray, marked: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """P(X >= k) marked among the drawn, by summing logs of the terms."""
    out = np.ones(len(k))
    for i, (k0, n, m, d) in enumerate(zip(np.asarray(k, int), np.asarray(total, int), np.asarray(marked, int), np.asarray(drawn, int), strict=True)):
        low, high = max(0, d + m - n), min(m, d)
        if k0 > high:
            out[i] = 0.0
        elif k0 > low:
            x = np.arange(k0, high + 1)
            logs = _lgamma(m + 1) - _lgamma(x + 1) - _lgamma(m - x + 1) + _lgamma(n - m + 1) - _lgamma(d - x + 1) - _lgamma(n - m - d + x + 1) - _lgamma(n + 1) + _lgamma(d + 1) + _lgamma(n - d + 1)
            out[i] = min(1.0, float(np.exp(logs - logs.max()).sum() * np.exp(logs.max())))
    return out


def p_t(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic."""

    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(a.to_numpy(float), b.to_numpy(float)))

    return f(t.cast("double"), df.cast("double"))


def p_normal(z: Column) -> Column:
    """Upper-tail p of a normal statistic."""

    @F.pandas_udf("double")
    def f(a: pd.Series) -> pd.Series:
        return pd.Series(normal_sf(a.to_numpy(float)))

    return f(z.cast("double"))


def p_hypergeom(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= k) of a hypergeometric count."""

    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hypergeom_sf(a, b, c, d))

    return f(*(x.cast("bigint") for x in (k, total, marked, drawn)))
