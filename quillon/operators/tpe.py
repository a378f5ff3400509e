"""Tree-structured Parzen estimation: where to try next, given the trials so far.

The best trials and the rest each give a density over the whole space at once: a mixture of one product kernel for each
trial and a uniform one. Candidates are drawn from the density of the good ones, and the one whose ratio of
both densities is largest is tried. Trials are a table; what is collected of it is the good ones, at most ``GOOD``.

Kernels are Gaussian on the unit cube and reflected at its faces, so that they need no normalisation and
are the same expression in SQL. The uniform part bounds densities from below, so sums need no logarithms.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of trials that count as good, and the most of them; trials before densities are used; candidates of a
#: draw; newest trials with full weight; width of a kernel for one trial, as a share of a range (fixed values).
GOOD_SHARE, GOOD = 0.1, 25
STARTUP = 10
CANDIDATES = 24
FULL_WEIGHT = 25
WIDTH = 0.2


@dataclass(frozen=True)
class Range:
    """A parameter; ``low`` and ``high`` are values of it, and whole numbers make it one."""

    name: str
    low: float
    high: float

    @property
    def whole(self) -> bool:
        return isinstance(self.low, int) and isinstance(self.high, int)

    def _edges(self) -> tuple[float, float]:
        return (self.low - 0.5, self.high + 0.5) if self.whole else (self.low, self.high)

    def unit(self, x):
        """A value's, or column's, place between 0 and 1."""
        a, b = self._edges()
        return (x - a) / (b - a)

    def value(self, u: float) -> float:
        a, b = self._edges()
        if self.whole:
            return int(min(max(round(a + u * (b - a)), self.low), self.high))
        return float(min(max(a + u * (b - a), a), b))


def width(n: int, dims: int) -> float:
    """Of the kernels of n trials: narrower the more there are, but never too narrow for so few."""
    return max(WIDTH * n ** (-1 / (dims + 4)), 1 / min(100, n + 1))


def log_kernel(x, at, h: float) -> Column:
    """Logarithm of the kernel of width h around ``at``, reflected at 0 and 1."""
    bell = lambda d: F.exp(-d * d / (2 * h * h))
    images = bell(x - at) + bell(x + at) + bell(2 - x - at)
    return F.ln(images) - math.log(h * math.sqrt(2 * math.pi))


def good_number(n: int) -> int:
    return min(math.ceil(GOOD_SHARE * n), GOOD)


def good_trials(trials: DataFrame, n: int | None = None) -> DataFrame:
    """The good ones of ``trials`` (trial, value, ...): the largest values; of equal ones the first trial. Trials without
    a value don't count, here and everywhere."""
    known = trials.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    n = known.count() if n is None else n
    return known.orderBy(F.desc("value"), "trial").limit(good_number(n))


def densities(trials: DataFrame, space: Sequence[Range], points: Sequence[dict[str, float]], good: Sequence | None = None) -> DataFrame:
    """One row for each of ``points``: candidate (its number), log_good and log_rest, the log densities of the good trials and of
    the rest, and score, their difference. ``trials``: trial (a number that grows), value and a column for
    each parameter, none of them NULL. Older trials weigh less. ``good``: the good ones' numbers, if known."""
    spark, dims = trials.sparkSession, len(space)
    known = trials.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    n, newest = known.agg(F.count(F.lit(1)), F.max("trial")).first()
    if not n:
        raise ValueError("there are no trials with a value")
    ids = [r["trial"] for r in good_trials(trials, n).select("trial").collect()] if good is None else list(good)
    is_good = F.col("trial").isin(ids)
    weight = F.when(is_good, 1.0).otherwise(F.least(F.lit(1.0), (F.col("trial") + 1) / F.lit(float(max(1, newest + 1 - FULL_WEIGHT)))))
    own = known.select(is_good.alias("good"), weight.alias("w"), *(p.unit(F.col(p.name)).alias(f"__{i}") for i, p in enumerate(space)))
    listed = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(float(p.unit(c[p.name]))).alias(f"c{i}") for i, p in enumerate(space))) for k, c in enumerate(points)))
    pairs = own.withColumn("c", F.explode(listed))
    h_good, h_rest = width(len(ids), dims), width(max(1, n - len(ids)), dims)
    kernel = lambda h: sum((log_kernel(F.col(f"c.c{i}"), F.col(f"__{i}"), h) for i in range(dims)), F.lit(0.0))
    mass = F.col("w") * F.exp(F.when(F.col("good"), kernel(h_good)).otherwise(kernel(h_rest)))
    sums = pairs.groupBy(F.col("c.k").alias("candidate")).agg(
        *(F.sum(F.when(F.col("good") == side, x).otherwise(0.0)).alias(f"{a}_{b}") for side, b in ((True, "good"), (False, "rest")) for x, a in ((mass, "mass"), (F.col("w"), "weight")))
    )
    log = lambda b: F.ln((1 + F.col(f"mass_{b}")) / (1 + F.col(f"weight_{b}")))
    return sums.select("candidate", log("good").alias("log_good"), log("rest").alias("log_rest"), (log("good") - log("rest")).alias("score"))


def draw(space: Sequence[Range], rng: np.random.Generator) -> dict[str, float]:
    return {p.name: p.value(rng.random()) for p in space}


def near(good: Sequence[dict[str, float]], space: Sequence[Range], rng: np.random.Generator) -> dict[str, float]:
    """A point drawn from the density of the good ones."""
    k = int(rng.integers(0, len(good) + 1))
    if k == len(good):
        return draw(space, rng)
    h, out = width(len(good), len(space)), {}
    for p in space:
        u = abs(p.unit(good[k][p.name]) + h * rng.normal())
        out[p.name] = p.value(abs(u - 2 * math.floor((u + 1) / 2)))  # reflected at 0 and 1
    return out


def propose(trials: DataFrame | None, space: Sequence[Range], seed: int, at_once: int = 1) -> list[dict[str, float]]:
    """The next points to try, ``at_once`` of them: random ones while there are fewer than STARTUP trials with a value, else the
    best by ratio of ``CANDIDATES`` drawn for each."""
    rng = np.random.default_rng(seed)
    n = 0 if trials is None else trials.filter("value IS NOT NULL AND NOT isnan(value)").count()
    if n < STARTUP:
        return [draw(space, rng) for _ in range(at_once)]
    good = good_trials(trials, n).collect()
    points = [near([r.asDict() for r in good], space, rng) for _ in range(CANDIDATES * at_once)]
    scores = {r["candidate"]: r["score"] for r in densities(trials, space, points, [r["trial"] for r in good]).collect()}
    return [points[max(range(i * CANDIDATES, (i + 1) * CANDIDATES), key=scores.__getitem__)] for i in range(at_once)]
