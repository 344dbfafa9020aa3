"""Distribution functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) by the continued fraction 1 / (1 + d1 / (1 + d2 / ...)), from
    its end to its beginning; at 0 and 1 exact."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.where(x >= 1, 1.0, 0.0)
    some = (x > 0) & (x < 1)
    if not some.any():
        return out
    a, b, x = a[some], b[some], x[some]
    turn = x >= (a + 1) / (a + b + 2)  # beyond it the fraction of the complement converges faster
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    tail = np.ones_like(y)
    for m in range(60 + int(3 * math.sqrt(max(p.max(), q.max()))), -1, -1):
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)) if m else None
        tail = 1 + odd / tail
        if m:
            tail = 1 + even / tail
    log = np.vectorize(math.lgamma)
    front = np.exp(log(p + q) - log(p) - log(q) + p * np.log(y) + q * np.log1p(-y)) / p
    got = front / tail
    out[some] = np.where(turn, 1 - got, got)
    return out


@F.pandas_udf(DoubleType())
def _two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    t, n = t.to_numpy(float), df.to_numpy(float)
    good = np.isfinite(t) & (n > 0)
    out = np.full(len(t), np.nan)
    out[good] = incomplete_beta(n[good] / 2, 0.5, n[good] / (n[good] + t[good] ** 2))
    return pd.Series(out).astype(object).where(good, None)


def student_p(t: Column, df: Column) -> Column:
    """The two-sided p-value of Student's t with df degrees of freedom; null
    without a t or with none."""
    return _two_sided(t.cast("double"), df.cast("double"))
