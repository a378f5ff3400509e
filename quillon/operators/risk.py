"""Risk: circuit breakers, gates for new positions, historical value at risk, drift."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.windows import by_time, cumulative
from quillon.operators.kolmogorov import p_values
from quillon.params import DriftConfig, RiskLimits


def breakers(equity: DataFrame, limits: RiskLimits | None = None, start: float | None = None) -> DataFrame:
    """Equity (symbol, ts, equity) with peak, drawdown, daily_return, halted and size_multiplier.

    A day's loss is measured against the peak so far; 60 % of its limit halves sizes for the day, the
    limit halts. 66 % of the largest drawdown halves sizes until the next day, the whole halts. A
    halt stays. ``start``: equity before the first row (that row's, if not given).
    """
    lim = limits or RiskLimits()
    df = equity.withColumn("__day", F.to_date("ts"))
    first = F.first("equity").over(by_time().rowsBetween(Window.unboundedPreceding, 0)) if start is None else F.lit(float(start))
    before = F.coalesce(F.lag("equity").over(by_time()), first)
    so_far = F.max("equity").over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    today = Window.partitionBy("symbol", "__day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"__pnl": F.col("equity") - before, "peak": so_far if start is None else F.greatest(so_far, F.lit(float(start)))})
    df = df.withColumn("daily_return", F.sum("__pnl").over(today) / F.greatest("peak", F.lit(1e-9)))
    df = df.withColumn("drawdown", F.when(F.col("peak") > 0, F.col("equity") / F.col("peak") - 1).otherwise(0.0))
    stop = (F.col("daily_return") <= -lim.daily_loss_limit) | (F.col("drawdown") <= -lim.max_drawdown)
    soft = (F.col("daily_return") <= -lim.daily_loss_limit * 0.6) | (F.col("drawdown") <= -lim.max_drawdown * 0.66)
    df = df.withColumns({"__stop": stop.cast("int"), "__soft": soft.cast("int")})
    df = df.withColumn("halted", cumulative(F.col("__stop")) > 0)
    half = F.max("__soft").over(today) > 0
    return df.withColumn("size_multiplier", F.when(F.col("halted"), 0.0).when(half, 0.5).otherwise(1.0)).drop("__day", "__pnl", "__stop", "__soft")


def tail(returns: DataFrame, n: int = 500) -> DataFrame:
    """The last n known returns of each symbol."""
    last = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return returns.filter("ret IS NOT NULL").withColumn("__rank", F.row_number().over(last)).filter(F.col("__rank") <= n).drop("__rank")


def value_at_risk(returns: DataFrame, n: int = 500, level: float = 0.05) -> DataFrame:
    """(symbol, rows, var): the loss at the level's quantile of the last n returns."""
    return tail(returns, n).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), (-F.percentile("ret", F.lit(level))).alias("var"))


def correlations(returns: DataFrame, n: int = 500) -> DataFrame:
    """(a, b, rows, corr) of each two symbols' last n returns at common times, a < b."""
    last = tail(returns, n)
    return _correlated(last, last, F.col("a") < F.col("b"))


def _correlated(left: DataFrame, right: DataFrame, pairs: Column) -> DataFrame:
    left = left.select("ts", F.col("symbol").alias("a"), F.col("ret").alias("x"))
    right = right.select("ts", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    return left.join(right, "ts").filter(pairs).groupBy("a", "b").agg(F.count(F.lit(1)).alias("rows"), F.corr("x", "y").alias("corr"))


def open_reasons(wanted: DataFrame, held: DataFrame, returns: DataFrame, halted: bool = False, limits: RiskLimits | None = None) -> DataFrame:
    """``wanted`` (symbol, side) with ok and reason, given ``held`` positions (symbol, side).

    In this order: halted; too many positions; already open; correlated with a position of the same
    side (50 common returns at least); value at risk too large (100 returns at least). Only wanted
    symbols are compared, and only with held ones.
    """
    lim = limits or RiskLimits()
    n_held = held.count()
    recent = tail(returns)
    of = lambda positions: recent.join(positions.select("symbol").distinct(), "symbol", "left_semi")
    both = _correlated(of(wanted), of(held), F.col("a") != F.col("b"))
    own = held.select(F.col("symbol").alias("b"), F.col("side").alias("held_side"))
    near = both.filter((F.col("rows") >= 50) & (F.abs("corr") >= lim.correlation_cap)).join(own, "b")
    near = wanted.join(near, F.col("symbol") == F.col("a")).filter("side = held_side").groupBy("symbol", "side").agg(F.min("b").alias("__near"))
    df = wanted.join(near, ["symbol", "side"], "left").join(value_at_risk(returns), "symbol", "left")
    df = df.join(held.select("symbol", F.lit(True).alias("__open")).distinct(), "symbol", "left")
    # users match on these reasons (fixed values)
    reason = (
        F.when(F.lit(halted), "halted")
        .when(F.lit(n_held >= lim.max_concurrent_positions), "max concurrent positions")
        .when(F.col("__open"), "position already open")
        .when(F.col("__near").isNotNull(), F.concat(F.lit("correlation cap vs "), "__near"))
        .when((F.col("rows") >= 100) & (F.col("var") > lim.var_limit), "value at risk")
        .otherwise("ok")
    )
    return df.withColumn("reason", reason).select("symbol", "side", (F.col("reason") == "ok").alias("ok"), "reason")


@dataclass(frozen=True)
class RiskState:
    """The breakers' state for one account, for drivers that step event by event."""

    equity: float
    peak: float
    day: str = ""
    daily_pnl: float = 0.0
    halted: bool = False
    reason: str = ""
    size_multiplier: float = 1.0
    positions: dict = field(default_factory=dict)

    @classmethod
    def start(cls, equity: float) -> "RiskState":
        return cls(equity, equity)

    def update(self, equity: float, day: str, limits: RiskLimits) -> "RiskState":
        new_day = day != self.day
        pnl = (0.0 if new_day else self.daily_pnl) + equity - self.equity
        peak = max(self.peak, equity)
        loss, fall = pnl / max(peak, 1e-9), equity / peak - 1 if peak > 0 else 0.0
        size = self.size_multiplier if self.halted or not new_day else 1.0
        halted, reason = self.halted, self.reason
        if not halted and (loss <= -0.6 * limits.daily_loss_limit or fall <= -0.66 * limits.max_drawdown):
            size = min(size, 0.5)
        for broken, why in ((loss <= -limits.daily_loss_limit, "daily loss limit"), (fall <= -limits.max_drawdown, "max drawdown")):
            if broken:
                halted, reason, size = True, why, 0.0
        return replace(self, equity=equity, peak=peak, day=day, daily_pnl=pnl, halted=halted, reason=reason, size_multiplier=size)

    def reset_halt(self) -> "RiskState":
        return replace(self, halted=False, reason="", size_multiplier=1.0)

    def opened(self, symbol: str, side: int) -> "RiskState":
        return replace(self, positions=self.positions | {symbol: side})

    def closed(self, symbol: str, pnl: float, day: str, limits: RiskLimits) -> "RiskState":
        rest = {k: v for k, v in self.positions.items() if k != symbol}
        return replace(self.update(self.equity + pnl, day, limits), positions=rest)

    def effective_risk(self, limits: RiskLimits) -> float:
        return limits.risk_per_trade * self.size_multiplier


# --- drift ---------------------------------------------------------------------------------------


def drift(reference: DataFrame, live: DataFrame, cfg: DriftConfig | None = None) -> DataFrame:
    """(symbol, rows, ks, ks_p, z, live_mean, ref_mean, drift) of live (symbol, ts, x) against
    reference (symbol, x): the last ``window`` live values; NULL and no drift below 50 of them.

    Both samples are ordered together once; the distance is the largest gap of their running shares. Its probability is
    exact for samples of up to 10,000 values.
    """
    cfg = cfg or DriftConfig()
    recent = live.filter("x IS NOT NULL").withColumn("__k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).filter(F.col("__k") <= cfg.window)
    both = reference.filter("x IS NOT NULL").select("symbol", "x", F.lit(1).alias("r"), F.lit(0).alias("l"))
    both = both.unionByName(recent.select("symbol", "x", F.lit(0).alias("r"), F.lit(1).alias("l")))
    at = both.groupBy("symbol", "x").agg(F.sum("r").alias("r"), F.sum("l").alias("l"))
    upto, every = Window.partitionBy("symbol").orderBy("x"), Window.partitionBy("symbol")
    share = lambda c: F.sum(c).over(upto) / F.when(F.sum(c).over(every) > 0, F.sum(c).over(every))
    gap = at.select("symbol", F.abs(share("r") - share("l")).alias("gap")).groupBy("symbol").agg(F.max("gap").alias("ks"))
    ref = reference.groupBy("symbol").agg(F.avg("x").alias("ref_mean"), (F.stddev_pop("x") + 1e-9).alias("ref_sd"), F.count("x").alias("m"))
    now = recent.groupBy("symbol").agg(F.avg("x").alias("live_mean"), F.count("x").alias("rows"))
    df = now.join(ref, "symbol").join(gap, "symbol")
    warm = F.col("rows") >= 50
    df = df.withColumns(
        {
            "ks": F.when(warm, F.col("ks")),
            "ks_p": F.when(warm, p_values(F.col("ks"), F.col("rows"), F.col("m"))),
            "z": F.when(warm, (F.col("live_mean") - F.col("ref_mean")) / F.col("ref_sd") * F.sqrt("rows")),
        }
    )
    drifted = warm & ((F.col("ks_p") < cfg.ks_p_threshold) | (F.abs("z") > cfg.mean_z_threshold))
    return df.select("symbol", "rows", "ks", "ks_p", "z", "live_mean", "ref_mean", F.coalesce(drifted, F.lit(False)).alias("drift"))


