"""Distribution functions as Arrow UDFs on numpy: normal, chi-squared, t and F upper tails."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_inc(a, b, x):
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    y = np.clip(y, 0, 1)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    with np.errstate(divide="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    out = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def gamma_upper(a, x):
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, x))
    x = np.maximum(x, 0)
    term = 1 / a
    total = term.copy()
    for n in range(1, 500):
        term = term * x / (a + n)
        total = total + term
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) - x - _lgamma(a))
    low = 1 - np.where(x > 0, total * front, 0.0)
    b = x + 1 - a
    c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for n in range(1, 500):
        an = -n * (n - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
    return np.where(x < a + 1, low, front * h)


@F.pandas_udf(DoubleType())
def normal_sf2(z: pd.Series) -> pd.Series:
    """Two-sided tail of the standard normal."""
    return pd.Series(_erfc(np.abs(z.to_numpy(dtype=float)) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(gamma_upper(df.to_numpy(dtype=float) / 2, x.to_numpy(dtype=float) / 2))


@F.pandas_udf(DoubleType())
def t_sf2(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t."""
    t, d = t.to_numpy(dtype=float), df.to_numpy(dtype=float)
    return pd.Series(beta_inc(d / 2, 0.5, d / (d + t * t)))


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    f, a, b = (v.to_numpy(dtype=float) for v in (f, d1, d2))
    return pd.Series(beta_inc(b / 2, a / 2, b / (b + a * np.maximum(f, 0))))
