"""Tail probabilities as column expressions and vectorised helpers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational Chebyshev fit of erfc (relative error below 1.2e-7); fixed values.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """erfc of a non-negative column."""
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def normal_tail(z: Column) -> Column:
    """P(Z >= z)."""
    half = erfc(F.abs(z) / F.lit(math.sqrt(2.0))) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of min(b,c) successes in b+c fair trials, log terms by recurrence."""
    n = (b + c).cast("double")
    k = F.least(b, c).cast("int")
    first = F.struct((-n * F.lit(math.log(2.0))).alias("l"), F.exp(-n * F.lit(math.log(2.0))).alias("s"))

    def step(acc, i):
        nxt = acc["l"] + F.log((n - i + 1) / i)
        return F.struct(nxt.alias("l"), (acc["s"] + F.exp(nxt)).alias("s"))

    terms = F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(terms, first, step, lambda acc: acc["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(2 * tail, F.lit(1.0)))


def _beta_tail(p, a, b):
    """Regularised incomplete beta I_p(a, b) by Lentz's continued fraction, vectorised."""
    lg = np.vectorize(math.lgamma)
    with np.errstate(all="ignore"):
        flip = p > (a + 1) / (a + b + 2)
        x, s, t = np.where(flip, 1 - p, p), np.where(flip, b, a), np.where(flip, a, b)
        front = np.exp(lg(s + t) - lg(s) - lg(t) + s * np.log(x) + t * np.log1p(-x)) / s
        tiny = 1e-300
        c = np.ones_like(x)
        d = 1 / np.where(np.abs(1 - (s + t) * x / (s + 1)) < tiny, tiny, 1 - (s + t) * x / (s + 1))
        h = d.copy()
        for m in range(1, 400):
            for num in (m * (t - m) * x / ((s + 2 * m - 1) * (s + 2 * m)), -(s + m) * (s + t + m) * x / ((s + 2 * m) * (s + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        out = np.where(x <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


def _clopper_pearson(k: pd.Series, n: pd.Series, conf: pd.Series) -> pd.DataFrame:
    """Bisection on the beta tail; constant memory per row whatever n is."""
    kk, nn = k.to_numpy(float), n.to_numpy(float)
    half = (1 - conf.to_numpy(float)) / 2

    def solve(a, b, target):
        lo, hi = np.zeros_like(a), np.ones_like(a)
        for _ in range(60):
            mid = (lo + hi) / 2
            below = _beta_tail(mid, a, b) < target
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return (lo + hi) / 2

    low = np.where(kk <= 0, 0.0, solve(np.maximum(kk, 1), nn - np.maximum(kk, 1) + 1, half))
    kh = np.minimum(kk, nn - 1)
    high = np.where(kk >= nn, 1.0, solve(kh + 1, np.maximum(nn - kh, 1), 1 - half))
    return pd.DataFrame({"lo": low, "hi": high})


def binom_ci(k, n, conf: float = 0.95) -> Column:
    """Struct (lo, hi): Clopper-Pearson interval columns."""
    return F.pandas_udf(_clopper_pearson, "lo double, hi double")(k, n, F.lit(conf))
