"""Distribution functions Spark lacks, vectorised over Arrow batches of result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    erf = np.vectorize(math.erf, otypes=[float])
    return pd.Series(0.5 * (1.0 + erf(z.to_numpy(dtype=float) / math.sqrt(2.0))), index=z.index)


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by the continued fraction (modified Lentz)."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(
            gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x)
        ) / a
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = front * h
    return np.where(flip, 1 - out, out)


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a Pearson coefficient (Student t with n - 2 degrees of freedom)."""
    rv, nv = r.to_numpy(dtype=float), n.to_numpy(dtype=float)
    df = np.maximum(nv - 2, 1e-9)
    x = np.clip(1 - rv * rv, 1e-300, 1.0)  # df / (df + t^2)
    p = np.where(nv > 2, np.where(x >= 1, 1.0, _incomplete_beta(df / 2, np.full_like(df, 0.5), np.minimum(x, 1 - 1e-16))), np.nan)
    return pd.Series(np.clip(p, 0.0, 1.0), index=r.index)
