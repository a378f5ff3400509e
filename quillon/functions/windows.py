"""Window expressions over a symbol's bars. Missing values are NULL and never counted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_time() -> WindowSpec:
    """Rows of a symbol in the order of time."""
    return Window.partitionBy("symbol").orderBy("ts")


def last_rows(n: int) -> WindowSpec:
    return by_time().rowsBetween(-(n - 1), 0)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, min_periods: int | None = None) -> Column:
    """``agg`` over the last n rows, NULL until min_periods (n) of them have a value."""
    frame = last_rows(n)
    return F.when(F.count(x).over(frame) >= (n if min_periods is None else min_periods), agg(x).over(frame))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.when(b != 0, b)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; NULL stays NULL."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def holds(condition: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return holds(condition).cast("double")


def zscore(x: Column, n: int = 100) -> Column:
    sd = rolling(F.stddev_pop, x, n, n // 2)
    return ratio(x - rolling(F.avg, x, n, n // 2), sd)


def ffill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))


def bfill(x: Column) -> Column:
    return F.first(x, ignorenulls=True).over(by_time().rowsBetween(0, Window.unboundedFollowing))


def pct_rank(x: Column, n: int, min_periods: int) -> Column:
    """Rank of x among the last n values, as a share; ties take their mean rank."""
    seen = F.collect_list(x).over(last_rows(n))
    below = F.size(F.filter(seen, lambda v: v < x))
    ties = F.size(F.filter(seen, lambda v: v == x))
    share = (below + (ties + 1) / F.lit(2.0)) / F.size(seen)
    return F.when((F.size(seen) >= min_periods) & x.isNotNull(), share)


def full_pct_rank(x: Column) -> Column:
    """Rank of x among all values of the symbol, as a share; ties take their mean rank."""
    known = Window.partitionBy("symbol", x.isNotNull())
    rank = F.rank().over(known.orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy("symbol", x))
    return F.when(x.isNotNull(), (rank + (ties - 1) / F.lit(2.0)) / F.count(x).over(Window.partitionBy("symbol")))


def changed(x: Column) -> Column:
    """1 where x differs from the row before, and on the first row."""
    before = F.lag(x).over(by_time())
    return F.when(before.isNull() | (x != before), 1).otherwise(0)


def cumulative(x: Column) -> Column:
    return F.sum(x).over(by_time().rowsBetween(Window.unboundedPreceding, 0))


def compounded(x: Column, frame: WindowSpec) -> Column:
    """Running product of 1 + x over ``frame``; 0 from the first x of -1 or less on."""
    lost = F.max((x <= -1).cast("int")).over(frame)
    return F.when(lost == 1, 0.0).otherwise(F.exp(F.sum(F.log1p(F.when(x > -1, x))).over(frame)))


def running_product(x: Column, frame: WindowSpec) -> Column:
    """Product of x over ``frame``, whatever its sign."""
    size = F.exp(F.sum(F.ln(F.when(x != 0, F.abs(x)))).over(frame))
    odd = F.sum((x < 0).cast("int")).over(frame) % 2 == 1
    return F.when(F.max((x == 0).cast("int")).over(frame) == 1, 0.0).when(odd, -size).otherwise(size)


def row_no() -> Column:
    """Number of a row within its symbol, from 0."""
    return F.row_number().over(by_time()) - 1


def position_in_run(run: str) -> Column:
    """Number of a row within its run, from 1. ``run``: a column with the run's number."""
    return F.row_number().over(Window.partitionBy("symbol", run).orderBy("ts"))
