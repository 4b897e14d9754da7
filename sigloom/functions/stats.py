"""Beta and F distributions."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def beta(a, b):
    return math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))


def regularised_beta(x, a, b, tolerance=1e-12, max_terms=500):
    """Regularised incomplete beta function of an array, by its continued fraction (evaluated with Lentz's method)."""
    x = np.asarray(x, dtype=float)
    mirrored = x > (a + 1) / (a + b + 2)
    y = np.clip(np.where(mirrored, 1 - x, x), 0, 1)
    p, q = np.where(mirrored, b, a), np.where(mirrored, a, b)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y)) / (p * beta(a, b))
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(y), 1 / guard(1 - (p + q) * y / (p + 1))
    value = d.copy()
    for m in range(1, max_terms):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1 / guard(1 + term * d)
            c = guard(1 + term / c)
            step = c * d
            value = value * step
        if np.all(np.abs(step - 1) < tolerance):
            break
    result = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * value))
    return np.where(mirrored, 1 - result, result)


def f_distribution_cdf(f, d1, d2):
    """Probability that an F variate with ``d1`` and ``d2`` degrees of freedom is at most ``f``."""
    @F.pandas_udf("double")
    def cdf(values: pd.Series) -> pd.Series:
        v = values.clip(lower=0).to_numpy(dtype=float)
        return pd.Series(regularised_beta(d1 * v / (d1 * v + d2), d1 / 2, d2 / 2))
    return cdf(f)
