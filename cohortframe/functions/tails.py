"""Tail probabilities on whole columns: small numpy helpers and the pandas UDFs around them.

They see aggregated rows only, one per test, never cells.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def normal_sf(z: np.ndarray) -> np.ndarray:
    """P(Z > z)."""
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2.0)).astype(float)


def chi2_1_sf(x: np.ndarray) -> np.ndarray:
    """P(X > x) for chi-square with one degree of freedom."""
    return _erfc(np.sqrt(np.maximum(np.asarray(x, float), 0.0) / 2.0)).astype(float)


def regularised_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """I_x(a, b) by its continued fraction, on the side where that converges fast."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1.0) / (a + b + 2.0)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(x), 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, rounds):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for step in (even, odd):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            factor = c * d
            value = value * factor
        if np.all(np.abs(factor - 1.0) < 1e-15):
            break
    log_beta = (_lgamma(a + b) - _lgamma(a) - _lgamma(b)).astype(float)
    with np.errstate(divide="ignore"):
        front = np.exp(log_beta + a * np.log(x) + b * np.log1p(-x)) / a
    part = np.where(x <= 0.0, 0.0, front * value)
    return np.where(flip, 1.0 - part, part)


def t_sf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for Student's t with ``df`` degrees of freedom, which need not be whole."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    half = 0.5 * regularised_beta(df / 2.0, np.full_like(df, 0.5), df / (df + t * t))
    return np.where(t >= 0, half, 1.0 - half)


def hypergeometric_sf(k: int, population: int, successes: int, draws: int) -> float:
    """P(X >= k): at least ``k`` marked ones among ``draws`` out of ``population``."""
    top = min(successes, draws)
    low = max(k, draws + successes - population, 0)
    if low > top:
        return 0.0
    if k <= max(0, draws + successes - population):
        return 1.0

    def log_choose(n, r):
        return math.lgamma(n + 1.0) - _lgamma(r + 1.0).astype(float) - _lgamma(n - r + 1.0).astype(float)

    i = np.arange(low, top + 1, dtype=float)
    whole = math.lgamma(population + 1.0) - math.lgamma(draws + 1.0) - math.lgamma(population - draws + 1.0)
    logs = log_choose(float(successes), i) + log_choose(float(population - successes), draws - i) - whole
    peak = logs.max()
    return float(min(1.0, math.exp(peak) * np.exp(logs - peak).sum()))


@lru_cache(maxsize=512)
def _rank_sum_cdf(n1: int, n2: int) -> np.ndarray:
    """P(U <= u) for u = 0 .. n1 * n2 without ties, by counting arrangements."""
    # ways[j]: number of choices of j ranks by their sum, ranks offered one by one.
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1.0
    for rank in range(1, n1 + n2 + 1):
        for j in range(min(rank, n1), 0, -1):
            shift = rank - j
            if shift <= n1 * n2:
                ways[j, shift:] += ways[j - 1, : n1 * n2 + 1 - shift]
    return np.cumsum(ways[n1]) / ways[n1].sum()


def exact_rank_sum_p(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p-value of the rank-sum statistic ``u`` of the first group."""
    cdf = _rank_sum_cdf(int(n1), int(n2))
    u = int(round(u))
    upper = 1.0 - (cdf[u - 1] if u > 0 else 0.0)
    return float(min(1.0, 2.0 * (upper if u > n1 * n2 / 2.0 else cdf[u])))


@F.pandas_udf(T.DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    return pd.Series(normal_sf(z.to_numpy(float)), dtype=float)


@F.pandas_udf(T.DoubleType())
def chi2_upper(x: pd.Series) -> pd.Series:
    return pd.Series(chi2_1_sf(x.to_numpy(float)), dtype=float)


@F.pandas_udf(T.DoubleType())
def t_upper(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_sf(t.to_numpy(float), df.to_numpy(float)), dtype=float)


@F.pandas_udf(T.DoubleType())
def hypergeometric_upper(k: pd.Series, population: pd.Series, successes: pd.Series, draws: pd.Series) -> pd.Series:
    rows = zip(k, population, successes, draws)
    return pd.Series([hypergeometric_sf(int(a), int(b), int(c), int(d)) for a, b, c, d in rows], dtype=float)


@F.pandas_udf(T.DoubleType())
def rank_sum_exact(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([exact_rank_sum_p(a, b, c) for a, b, c in zip(u, n1, n2)], dtype=float)
