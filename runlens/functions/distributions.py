"""Distribution functions: closed forms as column expressions, and the incomplete beta function as an Arrow UDF."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def erf(x: Column) -> Column:
    """The error function by a published rational approximation (absolute error below 1.5e-7)."""
    # Coefficients of Abramowitz and Stegun 7.1.26.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + F.abs(x) * p)
    series = F.lit(0.0)
    for c in reversed(a):
        series = (series + c) * t
    return F.signum(x) * (1 - series * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return (1 + erf(z / math.sqrt(2))) / 2


def two_sided_normal_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def chi2_quantile(z: Column, df: Column) -> Column:
    """Wilson-Hilferty: the chi-square quantile at the probability of normal quantile z."""
    v = 2 / (9 * df)
    return df * F.pow(1 - v + z * F.sqrt(v), F.lit(3))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution, by bisection on erfc."""
    low, high = np.full_like(p, -40.0), np.full_like(p, 40.0)
    cdf = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), otypes=[float])
    for _ in range(80):
        mid = (low + high) / 2
        below = cdf(mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by Lentz's continued fraction on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(y) + b * np.log1p(-y)) / a
    tiny = 1e-300
    c, d = np.ones_like(y), 1 / np.where(np.abs(1 - (a + b) * y / (a + 1)) < tiny, tiny, 1 - (a + b) * y / (a + 1))
    f = d.copy()
    for m in range(1, 300):
        even = m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    value = np.where(inside, front * f, np.where(x >= 1, 1.0, 0.0))
    return np.where(flip, 1 - value, value)


def student_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def student_quantile(p: float, df: float) -> float:
    """t with distribution function p, by bisection."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        tail = float(student_p(np.array(mid), np.array(df))) / 2
        low, high = (mid, high) if (1 - tail if mid > 0 else tail) < p else (low, mid)
    return (low + high) / 2


@pandas_udf(DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of t; NULL where t is NULL or df is not positive."""
    ok = (t.notna() & (df > 0)).to_numpy()
    p = student_p(np.where(ok, t.fillna(0), 0), np.where(ok, df.fillna(1), 1))
    return pd.Series(np.where(ok, p, np.nan)).where(ok, None)


@pandas_udf(DoubleType())
def t_quantile_975(df: pd.Series) -> pd.Series:
    """The 0.975 quantile of Student's t; NULL where df is not positive. Each df of a batch is solved once."""
    return df.map({d: student_quantile(0.975, d) for d in df.dropna().unique() if d > 0})


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation over n pairs, by Student's t."""
    clipped = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r))
    return t_test_p(clipped * F.sqrt(F.greatest(n - 2, F.lit(0)) / (1 - clipped * clipped)), (n - 2).cast("double"))


def fisher_interval(r: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Confidence limits of a correlation; NULL for fewer than 4 pairs or |r| = 1."""
    ok = (n >= 4) & (F.abs(r) < 1)
    centre, half = F.when(ok, F.atanh(r)), F.when(ok, z / F.sqrt(F.greatest(n - 3, F.lit(1))))
    return F.tanh(centre - half), F.tanh(centre + half)
