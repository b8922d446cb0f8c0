"""Tail probabilities as Arrow-batched functions. They run on result tables (one row per feature), not on samples."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def np_lgamma(x) -> np.ndarray:
    """log Gamma for x > 0: shift by 8, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    z = x + 8.0
    z2 = z * z
    series = 1 / (12 * z) - 1 / (360 * z * z2) + 1 / (1260 * z * z2 * z2) - 1 / (1680 * z * z2 ** 3)
    series += 1 / (1188 * z * z2 ** 4) - 691 / (360360 * z * z2 ** 5)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def np_betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz), vectorised."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - np.log(p) - np_lgamma(p) - np_lgamma(q) + np_lgamma(p + q))
        tiny = 1e-300
        c = np.ones_like(y)
        d = 1.0 - (p + q) * y / (p + 1)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            d = 1.0 + even * d
            c = 1.0 + even / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            h = h * d * np.where(np.abs(c) < tiny, tiny, c)
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1.0 + odd * d
            c = 1.0 + odd / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            step = d * np.where(np.abs(c) < tiny, tiny, c)
            h = h * step
            if np.all(np.isnan(step) | (np.abs(step - 1) < 1e-15)):
                break
        val = np.where(y == 0, 0.0, front * h)
    return np.where(swap, 1.0 - val, val)


def np_gammaincc(s, x) -> np.ndarray:
    """Regularised upper incomplete gamma: series below s + 1, continued fraction above."""
    s, x = np.broadcast_arrays(np.asarray(s, dtype=float), np.asarray(x, dtype=float))
    with np.errstate(all="ignore"):
        front = np.exp(s * np.log(x) - x - np_lgamma(s))
        term = 1.0 / s
        total = term.copy()
        for i in range(1, 2000):
            term = term * x / (s + i)
            total = total + term
            if np.all(np.isnan(term) | (np.abs(term) < np.abs(total) * 1e-16) | (x >= s + 1)):
                break
        low = 1.0 - front * total
        b = x + 1.0 - s
        c = np.full_like(b, 1e300)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - s)
            b = b + 2.0
            d = 1.0 / (an * d + b)
            c = b + an / c
            step = d * c
            h = h * step
            if np.all(np.isnan(step) | (np.abs(step - 1) < 1e-15) | (x < s + 1)):
                break
        high = front * h
    return np.where(x <= 0, 1.0, np.where(x < s + 1, low, high))


def np_t_quantile(df, level: float = 0.95) -> np.ndarray:
    """Two-sided Student t quantile: halving on the incomplete beta; the expansion in 1/df where its error is below 1e-12."""
    df = np.asarray(df, dtype=float)
    z = NormalDist().inv_cdf((1 + level) / 2)
    g = [(z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96, (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384,
         (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160]
    n = np.minimum(df, 1000.0)
    lo, hi = np.zeros_like(n), np.full_like(n, 1e8)
    for _ in range(100):
        mid = (lo + hi) / 2
        inside = np_betainc(n / 2, 0.5, n / (n + mid * mid)) > 1 - level
        lo, hi = np.where(inside, mid, lo), np.where(inside, hi, mid)
    return np.where(df > 1000, z + sum(v / df ** (i + 1) for i, v in enumerate(g)), (lo + hi) / 2)


def _series(values, ok) -> pd.Series:
    return pd.Series(np.where(ok, values, np.nan)).where(pd.Series(np.asarray(ok)), None).astype("Float64")


@F.pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, dfn: pd.Series, dfd: pd.Series) -> pd.Series:
    """P(F > f)."""
    f, n, d = (v.astype(float).to_numpy() for v in (f, dfn, dfd))
    ok = ~(np.isnan(f) | np.isnan(n) | np.isnan(d)) & (n > 0) & (d > 0)
    with np.errstate(all="ignore"):
        p = np.where(np.isinf(f), 0.0, np_betainc(np.where(ok, d, 1) / 2, np.where(ok, n, 1) / 2,
                                                   np.where(ok, d / (d + n * np.where(np.isinf(f), 1, f)), 0.5)))
    return _series(p, ok)


@F.pandas_udf(T.DoubleType())
def t_sf2(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided P(|T| > |t|)."""
    t, d = t.astype(float).to_numpy(), df.astype(float).to_numpy()
    ok = ~(np.isnan(t) | np.isnan(d)) & (d > 0)
    with np.errstate(all="ignore"):
        x = np.where(np.isinf(t), 0.0, d / (d + np.where(np.isinf(t), 0, t) ** 2))
        p = np_betainc(np.where(ok, d, 1) / 2, 0.5, np.where(ok, x, 0.5))
    return _series(p, ok)


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(chi-square with df > x)."""
    x, d = x.astype(float).to_numpy(), df.astype(float).to_numpy()
    ok = ~(np.isnan(x) | np.isnan(d)) & (d > 0)
    return _series(np_gammaincc(np.where(ok, d, 1) / 2, np.where(ok, x, 1) / 2), ok)


@F.pandas_udf(T.DoubleType())
def norm_sf2(z: pd.Series) -> pd.Series:
    """Two-sided normal tail."""
    z = z.astype(float).to_numpy()
    ok = ~np.isnan(z)
    return _series(np_gammaincc(0.5, np.where(ok, z, 0) ** 2 / 2), ok)


def _log_hyper(k, n_pop, n_good, n_draw):
    """log P(K = k), K hypergeometric."""
    def lc(n, r):
        return np_lgamma(n + 1.0) - np_lgamma(r + 1.0) - np_lgamma(n - r + 1.0)
    return lc(n_good, k) + lc(n_pop - n_good, n_draw - k) - lc(n_pop, n_draw)


def _support(n_pop, n_good, n_draw, around):
    """Support of the distribution, cut 45 sd away from mode and ``around``, where the mass is below 1e-300."""
    lo, hi = max(0, n_draw + n_good - n_pop), min(n_good, n_draw)
    mean = n_draw * n_good / n_pop
    sd = np.sqrt(max(mean * (1 - n_good / n_pop) * (n_pop - n_draw) / max(n_pop - 1, 1), 0.0))
    return np.arange(max(lo, int(min(mean, around) - 45 * sd - 60)), min(hi, int(max(mean, around) + 45 * sd + 60)) + 1)


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p: total probability of the tables that are no likelier than the observed one."""
    n, good, draw = a + b + c + d, a + c, a + b
    if n == 0 or good in (0, n) or draw in (0, n):
        return 1.0
    k = _support(n, good, draw, a)
    lp = _log_hyper(k, n, good, draw)
    obs = lp[int(a - k[0])]
    return float(min(1.0, np.exp(lp[lp <= obs + 1e-7]).sum()))


@F.pandas_udf(T.DoubleType())
def fisher2(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher exact p of [[a, b], [c, d]]."""
    return pd.Series([fisher_p(*(int(v) for v in t)) for t in zip(a, b, c, d)], dtype=float)


@F.pandas_udf(T.DoubleType())
def hyper_sf(k: pd.Series, n_pop: pd.Series, n_good: pd.Series, n_draw: pd.Series) -> pd.Series:
    """P(K >= k) for n_draw draws from n_pop with n_good marked."""
    out = []
    for kk, m, g, n in zip(k, n_pop, n_good, n_draw):
        s = _support(int(m), int(g), int(n), int(kk))
        s = s[s >= kk]
        out.append(float(min(1.0, np.exp(_log_hyper(s, int(m), int(g), int(n))).sum())) if len(s) else 0.0)
    return pd.Series(out, dtype=float)


@F.pandas_udf(T.DoubleType())
def t_quantile95(df: pd.Series) -> pd.Series:
    """Half-width of the central 95% of Student's t in standard units; null below one degree of freedom."""
    d = df.astype(float).to_numpy()
    ok = d >= 1
    return _series(np_t_quantile(np.where(ok, d, 1.0)), ok)
