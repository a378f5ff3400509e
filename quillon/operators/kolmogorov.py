"""P-values of the two-sample Kolmogorov-Smirnov distance."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The larger sample's size up to which p-values are exact (a fixed value).
EXACT_UP_TO = 10_000


@lru_cache(maxsize=4096)
def exact_p(reach: int, n: int, m: int) -> float:
    """Probability of a distance of at least reach / (n m) between samples of n and m values without ties.

    The order of both samples together is a lattice path from (0, 0) to (n, m), and all paths are alike. The chance of
    having stayed within the reach is carried from one antidiagonal to the next; a path at (i, j) goes on in the
    first sample with the share (n - i) of what is left. What leaves the band is summed, so that small chances are exact.
    """
    if reach <= 0:
        return 1.0
    i = np.arange(n + 1)
    inside, lost = np.zeros(n + 1), 0.0
    inside[0] = 1.0
    for s in range(n + m):
        rest = n + m - s
        onward = inside * (m - (s - i)) / rest
        onward[1:] += inside[:-1] * (n - i[:-1]) / rest
        j = s + 1 - i
        out = np.abs(i * m - j * n) >= reach
        lost += onward[out].sum()
        onward[out] = 0.0
        inside = onward
    return min(1.0, lost)


def asymptotic_p(lam: float) -> float:
    if lam < 0.2:
        return 1.0
    return min(1.0, max(0.0, sum(2.0 * (-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam) for k in range(1, 26))))


def p_value(d: float, n: int, m: int) -> float:
    """Of the distance d between samples of n and m values: exact for sizes up to EXACT_UP_TO, else asymptotic."""
    if max(n, m) <= EXACT_UP_TO:
        return exact_p(round(d * n * m), n, m)
    return asymptotic_p(math.sqrt(n * m / (n + m)) * d)


def p_values(d: Column, n: Column, m: Column) -> Column:
    """``p_value`` by row; one row a symbol."""

    @F.pandas_udf("double")
    def of(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else p_value(float(x), int(a), int(b)) for x, a, b in zip(d, n, m, strict=True)], dtype=float)

    return of(d, n, m)
