"""Event-driven backtest: gates, barriers with trailing stops, one position at a time, equity, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.windows import bfill, by_time, compounded, ffill, ratio, row_no
from quillon.operators import machines
from quillon.operators import recursions as R
from quillon.operators.labels import band_join
from quillon.params import BacktestConfig
from quillon.storage import stage


def gate_events(events: DataFrame, bars: DataFrame, signals: DataFrame, cfg: BacktestConfig, proba: DataFrame | None = None) -> DataFrame:
    """Events that lie on a bar and have a side, and if ``proba`` (symbol, ts, prob) is given at least
    the threshold there; with the columns side and mode of ``signals``."""
    on_bars = events.select("symbol", "ts").distinct().join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_semi")
    out = on_bars.join(signals.select("symbol", "ts", "side", "mode"), ["symbol", "ts"]).filter("side <> 0")
    if proba is not None:
        out = out.join(proba.select("symbol", "ts", "prob"), ["symbol", "ts"], "left")
        out = out.filter(F.coalesce("prob", F.lit(0.0)) >= cfg.meta_threshold).drop("prob")
    return out


def barrier_plan(candidates: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """``candidates`` (with mode and atr_frac) with pt_frac, sl_frac, hold and trail (NULL: none) by mode,
    after the cost gate: targets are widened until they pay for costs and risk, or the row is dropped
    if that takes more than max_pt_atr; small targets are scaled up together with their stops."""
    mode, atr = F.col("mode"), F.col("atr_frac")
    by_mode = lambda trend, ranging, other: F.when(mode == 1, F.lit(trend)).when(mode == 2, F.lit(ranging)).otherwise(F.lit(other))
    rt, rr = cfg.round_trip, cfg.cost_adj_min_rr
    df = candidates.withColumns(
        {
            "__pt": by_mode(cfg.trend_pt_atr, cfg.range_pt_atr, cfg.pt_mult) * atr,
            "__sl": by_mode(cfg.trend_sl_atr, cfg.range_sl_atr, cfg.sl_mult) * atr,
            "hold": by_mode(cfg.trend_max_hold_bars, cfg.range_max_hold_bars, cfg.max_hold_bars).cast("int"),
            "trail": F.when(mode == 1, F.lit(cfg.trend_trail_atr)),
        }
    )
    win, loss = F.col("__pt") - rt, F.col("__sl") + rt
    poor = (win <= 0) | (win / F.greatest(loss, F.lit(1e-9)) < rr)
    df = df.withColumns({"__poor": poor, "__need": rr * loss + rt})
    df = df.filter(~F.col("__poor") | (F.col("__need") / atr <= cfg.max_pt_atr))
    df = df.withColumn("__pt", F.when(F.col("__poor"), F.col("__need")).otherwise(F.col("__pt")))
    scale = F.when(F.col("__pt") < cfg.min_target_frac, cfg.min_target_frac / F.greatest("__pt", F.lit(1e-9))).otherwise(1.0)
    return df.withColumns({"pt_frac": F.col("__pt") * scale, "sl_frac": F.col("__sl") * scale}).drop("__pt", "__sl", "__poor", "__need")


def resolve_barriers(plan: DataFrame, bars: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """``plan`` (symbol, e, side, atr_frac, pt_frac, sl_frac, hold, trail, ...) with exit_n, gross_ret and
    barrier. ``bars``: (symbol, n, close).

    On each later close: target (fills at the target), stop (fills at the stop), then the trailing
    stop, which holds once the best return has passed 0.8 ATR and locks in a gain (label 1). Else the
    trade ends at ``hold`` rows or the last bar. All events are resolved at once, whether taken or not.
    """
    longest = max(cfg.trend_max_hold_bars, cfg.range_max_hold_bars, cfg.max_hold_bars)
    keys = [c for c in plan.columns if c != "close"]
    start = plan.join(bars.select("symbol", F.col("n").alias("e"), F.col("close").alias("c0")), ["symbol", "e"])
    path = band_join(start, bars.select("symbol", "n", "close"), longest).filter(F.col("n") <= F.col("e") + F.col("hold"))
    path = path.withColumn("r", F.col("side") * (F.col("close") / F.col("c0") - 1))
    so_far = Window.partitionBy("symbol", "e").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumn("peak", F.greatest(F.max("r").over(so_far), F.lit(0.0)))
    atr = F.greatest("atr_frac", F.lit(1e-6))
    level = F.col("peak") - F.col("trail") * atr
    later, r = F.col("n") > F.col("e"), F.col("r")
    trailing = F.col("trail").isNotNull() & (F.col("peak") > atr * 0.8) & (r <= level) & (level > 0)
    exit_at = lambda ret, label: F.struct("n", ret.alias("ret"), F.lit(label).alias("label"))
    outcome = (
        F.when(later & (r >= F.col("pt_frac")), exit_at(F.col("pt_frac"), 1))
        .when(later & (r <= -F.col("sl_frac")), exit_at(-F.col("sl_frac"), -1))
        .when(later & trailing, exit_at(r, 1))
    )
    path = path.withColumn("hit", outcome)
    done = path.groupBy(*keys).agg(F.min("hit").alias("hit"), F.max(exit_at(r, 0)).alias("end"))
    best = F.coalesce("hit", "end")
    return done.select(*keys, best["n"].alias("exit_n"), best["ret"].alias("gross_ret"), best["label"].alias("barrier"))


def one_position(resolved: DataFrame, order: str = "e", streamed: bool = False) -> DataFrame:
    """The trades that begin after the one taken before has ended, by symbol. Works on the small table
    of candidates, not on bars; ``streamed`` if a symbol's candidates don't fit in memory."""
    if streamed:
        taken = machines.run(resolved.select("symbol", F.col(order).cast("bigint").alias("e"), F.col("exit_n").cast("bigint").alias("exit_n")), "e", machines.OnePosition)
        return resolved.join(taken.select("symbol", F.col("e").alias(order)), ["symbol", order])
    slim = resolved.select("symbol", F.col(order).alias("ts"), "exit_n")
    taken = R.per_symbol(slim, lambda p: {"taken": R.one_at_a_time(p["ts"], p["exit_n"])}, {"taken": "boolean"})
    return resolved.join(taken.filter("taken").select("symbol", F.col("ts").alias(order)), ["symbol", order])


def trade_ledger(trades: DataFrame, bars: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """The ledger of ``trades`` (entry e, exit_n): 16 fields and the symbol. ``bars``: (symbol, n, ts, close)."""
    entry = bars.select("symbol", F.col("n").alias("e"), F.col("ts").alias("entry_time"), F.col("close").alias("entry"))
    leave = bars.select("symbol", F.col("n").alias("exit_n"), F.col("ts").alias("exit_time"), F.col("close").alias("exit"))
    df = trades.join(entry, ["symbol", "e"]).join(leave, ["symbol", "exit_n"])
    seconds = F.unix_micros(F.col("exit_time").cast("timestamp")) - F.unix_micros(F.col("entry_time").cast("timestamp"))
    df = df.withColumn("hold_hours", F.greatest(seconds / F.lit(3.6e9), F.lit(0.0)))
    df = df.withColumn("net_ret", F.col("gross_ret") - cfg.round_trip - F.col("hold_hours") / 8.0 * (cfg.funding_bps_per_8h / 1e4))
    df = df.withColumn("size_frac", F.least(cfg.risk_per_trade / F.greatest("sl_frac", F.lit(1e-4)), F.lit(cfg.max_leverage)))
    growth = F.col("size_frac") * F.col("net_ret")
    order = Window.partitionBy("symbol").orderBy("e")
    # a loss of everything ends the equity at 0
    grown = compounded(growth, order.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("equity_after", cfg.starting_equity * grown)
    before = F.coalesce(F.lag("equity_after").over(order), F.lit(cfg.starting_equity))
    return df.withColumn("pnl", F.col("equity_after") - before).select(
        "symbol", "entry_time", "exit_time", F.col("side").cast("int").alias("side"), F.col("mode").cast("int").alias("mode"), "entry", "exit", "atr_frac",
        "pt_frac", "sl_frac", "gross_ret", "net_ret", "size_frac", "pnl", "equity_after", "barrier", "hold_hours", "e", "exit_n",
    )


def equity_curve(ledger: DataFrame, bars: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """(symbol, ts, equity, ret) for every bar (symbol, n, ts) of the symbols in ``bars``.

    With equity_stamp "reference" a bar shows the equity after the first trade that ends later (the
    last one's after all); with "exit" that after the last trade ended.
    """
    marks = ledger.select("symbol", F.col("exit_n").alias("n"), "equity_after")
    df = bars.select("symbol", "n", "ts").join(marks, ["symbol", "n"], "left")
    past = F.last("equity_after", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    future = F.first("equity_after", ignorenulls=True).over(by_time().rowsBetween(1, Window.unboundedFollowing))
    value = F.coalesce(future, past) if cfg.equity_stamp == "reference" else past
    df = df.withColumn("equity", F.coalesce(value, F.lit(cfg.starting_equity)))
    change = ratio(F.col("equity"), F.lag("equity").over(by_time())) - 1
    return df.select("symbol", "ts", "equity", F.coalesce(change, F.lit(0.0)).alias("ret"))


def performance(curve: DataFrame, ledger: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """One row per symbol with a trade: n_trades, sharpe, sortino, max_drawdown, cagr, calmar, win_rate,
    profit_factor, avg_trade_ret and, by mode, *_n, *_win, *_mean_ret. All but n_trades are NULL where
    returns don't vary; profit_factor is NULL without losses."""
    grown = compounded(F.col("ret"), by_time().rowsBetween(Window.unboundedPreceding, 0))
    df = curve.withColumn("__eq", grown)
    df = df.withColumn("__dd", F.col("__eq") / F.max("__eq").over(by_time().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    by_bar = df.groupBy("symbol").agg(
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("sd"),
        F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("down"),
        F.min("__dd").alias("dd"),
        F.max_by("__eq", "ts").alias("end"),
        F.count(F.lit(1)).alias("bars"),
    )
    net, mode = F.col("net_ret"), F.col("mode")
    aggs = [
        F.count(F.lit(1)).alias("n_trades"),
        F.avg((net > 0).cast("double")).alias("win"),
        F.sum(F.when(net > 0, net)).alias("gains"),
        (-F.sum(F.when(net < 0, net))).alias("losses"),
        F.avg("net_ret").alias("mean_net"),
    ]
    for m, name in ((1, "trend"), (2, "range")):
        own = F.when(mode == m, net)
        aggs += [F.count(own).alias(f"{name}_n"), F.avg(F.when(mode == m, (net > 0).cast("double"))).alias(f"{name}_win"), F.avg(own).alias(f"{name}_mean_ret")]
    by_trade = ledger.groupBy("symbol").agg(*aggs)
    ann = F.sqrt(F.lit(float(cfg.bars_per_year)))
    varies = F.col("sd") > 0
    some = lambda x: F.when(varies, x)
    cagr = F.pow("end", cfg.bars_per_year / F.greatest("bars", F.lit(1))) - 1
    out = by_trade.join(by_bar, "symbol").withColumn("cagr", some(cagr))
    return out.select(
        "symbol",
        "n_trades",
        some(F.col("mean") / F.when(varies, F.col("sd")) * ann).alias("sharpe"),
        some(F.col("mean") / F.when(F.col("down") > 0, F.col("down")) * ann).alias("sortino"),
        some(F.col("dd")).alias("max_drawdown"),
        "cagr",
        some(F.col("cagr") / F.abs(F.when(F.col("dd") != 0, F.col("dd")))).alias("calmar"),
        some(F.col("win")).alias("win_rate"),
        some(F.coalesce("gains", F.lit(0.0)) / F.when(F.col("losses") > 0, F.col("losses"))).alias("profit_factor"),
        some(F.col("mean_net")).alias("avg_trade_ret"),
        *(some(F.col(f"{n}_{c}")).alias(f"{n}_{c}") for n in ("trend", "range") for c in ("n", "win", "mean_ret")),
    )


def default_atr(bars: DataFrame) -> DataFrame:
    """(symbol, ts, atr_frac) where no ATR is given: 14-bar exponential mean of absolute log returns."""
    r = F.coalesce(F.abs(F.ln("close") - F.lag(F.ln(F.col("close"))).over(by_time())), F.lit(0.0))
    df = bars.select("symbol", "ts", r.alias("__r"))
    return R.per_symbol(df, lambda p: {"atr_frac": R.ewm_mean(p["__r"], 2 / 15)}, {"atr_frac": "double"}).drop("__r")


def run_backtest(bars: DataFrame, events: DataFrame, signals: DataFrame, cfg: BacktestConfig | None = None, proba: DataFrame | None = None, atr: DataFrame | None = None) -> dict[str, DataFrame]:
    """trades, equity and stats of events (symbol, ts) on bars, with signals (symbol, ts, side, mode) and
    atr (symbol, ts, atr_frac); see the operators above. Events in the last two bars are skipped. Numbered bars, outcomes and
    the ledger are written once."""
    cfg = cfg or BacktestConfig()
    atr = default_atr(bars) if atr is None else atr
    df = bars.select("symbol", "ts", "close").join(atr.select("symbol", "ts", "atr_frac"), ["symbol", "ts"], "left")
    filled: Column = F.coalesce(ffill(F.col("atr_frac")), bfill(F.col("atr_frac")))
    last = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    df = stage(df.select("symbol", "ts", "close", row_no().alias("n"), F.greatest(filled, F.lit(1e-4)).alias("atr_frac"), last.alias("rows")), "numbered")
    gated = gate_events(events, bars, signals, cfg, proba).join(df.select("symbol", "ts", F.col("n").alias("e"), "atr_frac", "rows"), ["symbol", "ts"])
    plan = barrier_plan(gated.filter(F.col("e") < F.col("rows") - 2).drop("rows", "ts"), cfg)
    numbered = df.select("symbol", "n", "ts", "close")
    # each of these is read several times
    resolved = stage(resolve_barriers(plan, numbered, cfg), "resolved")
    ledger = stage(trade_ledger(one_position(resolved), numbered, cfg), "ledger")
    curve = equity_curve(ledger, numbered, cfg)
    return {"trades": ledger, "equity": curve, "stats": performance(curve, ledger, cfg)}
