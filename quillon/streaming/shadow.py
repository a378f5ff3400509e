"""The shadow loop: signals of new bars as paper fills, and their trades, in tables.

Below ``ledger``: ``fills``, what each new bar says; ``trades``, positions that have ended, with prices and returns; and
``open``, those that haven't after a batch. A batch's part of each is written once more if the batch is
repeated after a failure, from what the batches before it left; so no fill and no trade is there twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.windows import row_no
from quillon.operators import backtest, risk
from quillon.operators import recursions as R
from quillon.operators.features import log_return
from quillon.operators.meta import MetaModel
from quillon.params import INTERVALS, BacktestConfig, RiskLimits, RunnerConfig
from quillon.plans import research
from quillon.sources.bars import BAR_COLUMNS, append_bars, read_bars
from quillon.storage import stage, temporary

FILLS = "symbol string, ts timestamp_ntz, side int, score double, mode int, prob double, price double, atr double, atr_pct double, vol_64 double, action string, reason string"
TRADES = (
    "symbol string, entry_time timestamp_ntz, exit_time timestamp_ntz, side int, mode int, entry double, exit double, atr_frac double, pt_frac double, sl_frac double, "
    "gross_ret double, net_ret double, size_frac double, barrier int, hold_hours double"
)
OPEN = "symbol string, ts timestamp_ntz, side int, mode int, pt_frac double, sl_frac double"
_MINUTES = {name: {"minute": 1, "minutes": 1, "hour": 60, "hours": 60, "day": 1440}[text.split()[1]] * int(text.split()[0]) for name, text in INTERVALS.items()}


def check_history(s: research.Settings, runner: RunnerConfig) -> None:
    """An error if ``history_days`` of bars can't fill the features, as nothing would ever be judged then."""
    needed = len(R.ffd_weights(s.features.frac_d)) - 1 + runner.min_feature_rows
    there = runner.history_days * 1440 // _MINUTES[runner.interval]
    if there < max(needed, runner.min_bars):
        days = -(-max(needed, runner.min_bars) * _MINUTES[runner.interval] // 1440)
        raise ValueError(f"{runner.history_days} days are {there} bars of {INTERVALS[runner.interval]}, features need {needed}: history_days must be {days} at least")


def _before(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """What the batches before this one have written to ``path``."""
    try:
        found = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return found.filter(F.col("batch") < batch_id)


def gated(said: DataFrame, held: DataFrame, bars: DataFrame, limits: RiskLimits, halted: bool = False) -> DataFrame:
    """``said`` with reason; fills that the risk gates refuse, given the positions ``held`` (symbol, side) before, get the action
    "blocked". Of new symbols in one batch the first ones take the places that are left. A symbol that is held isn't
    refused for that: its position may end before the fill, which ``settle`` sees to."""
    wanted = said.filter("action = 'paper_fill'").select("symbol", "side").distinct()
    returns = bars.select("symbol", "ts", log_return().alias("ret")).filter("ret IS NOT NULL")
    reasons = risk.open_reasons(wanted, held, returns, halted, limits).drop("ok")
    first = said.filter("action = 'paper_fill'").groupBy("symbol").agg(F.min("ts").alias("first")).join(held.select("symbol"), "symbol", "left_anti")
    places = limits.max_concurrent_positions - held.count()
    # one row a symbol
    late = first.withColumn("place", F.row_number().over(Window.orderBy("first", "symbol"))).filter(F.col("place") > places).select("symbol", F.lit(True).alias("late"))
    out = said.join(reasons, ["symbol", "side"], "left").join(late, "symbol", "left")
    why = F.when(F.col("late"), "max concurrent positions").otherwise(F.col("reason"))
    fills = F.col("action") == "paper_fill"
    out = out.withColumn("reason", F.when(fills, F.when(why == "position already open", "ok").otherwise(why)))
    return out.withColumn("action", F.when(fills & (F.col("reason") != "ok"), "blocked").otherwise(F.col("action"))).drop("late")


def settle(fills: DataFrame, bars: DataFrame, ended: DataFrame, cfg: BacktestConfig) -> tuple[DataFrame, DataFrame]:
    """(trades, open) of ``fills`` (symbol, ts, side, mode, atr_pct) on ``bars``, one position a symbol at a time.

    Targets, stops and trailing stops as in the backtest. A fill counts if it is later than the exit of
    the trade before, first that of ``ended`` (symbol, exit_time). A position has ended where a bar reached a barrier or the
    last bar of its hold; before that it is open and later fills wait for its end.
    """
    numbered = stage(bars.select("symbol", "ts", "close", row_no().alias("n")), "numbered")
    last = numbered.groupBy("symbol").agg(F.max("n").alias("last"))
    new = fills.join(ended.groupBy("symbol").agg(F.max("exit_time").alias("until")), "symbol", "left").filter("until IS NULL OR ts > until").drop("until")
    candidates = new.select("symbol", "ts", "side", "mode", F.greatest("atr_pct", F.lit(1e-4)).alias("atr_frac")).join(numbered.select("symbol", "ts", F.col("n").alias("e")), ["symbol", "ts"])
    plan = backtest.barrier_plan(candidates, cfg)
    met = backtest.resolve_barriers(plan, numbered.select("symbol", "n", "close"), cfg).join(last, "symbol")
    over = (F.col("barrier") != 0) | (F.col("exit_n") >= F.col("e") + F.col("hold"))
    met = stage(met.withColumn("over", over).withColumn("exit_n", F.when(over, F.col("exit_n")).otherwise(F.lit(2**62))), "met")
    taken = backtest.one_position(met)
    ledger = backtest.trade_ledger(taken.filter("over"), numbered, cfg)
    trades = ledger.select(*(c.split()[0] for c in TRADES.split(", ")))
    return trades, taken.filter("NOT over").select("symbol", "ts", F.col("side").cast("int").alias("side"), F.col("mode").cast("int").alias("mode"), "pt_frac", "sl_frac")


def shadow_batch(
    batch: DataFrame, batch_id: int, cache: str, ledger: str, s: research.Settings, model: MetaModel | None, runner: RunnerConfig, limits: RiskLimits
) -> None:
    """Appends the batch's bars to the cache, judges each of them that is later than all judged before, and settles fills."""
    spark = batch.sparkSession
    with temporary(spark):
        new = stage(batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "new")
        if not new.limit(1).count():
            return
        append_bars(new, cache)
        fills, ended = (_before(spark, f"{ledger}/{name}", schema, batch_id) for name, schema in (("fills", FILLS), ("trades", TRADES)))
        opened = _before(spark, f"{ledger}/open", OPEN, batch_id).filter(F.col("batch") == batch_id - 1)
        since = new.agg(F.min("ts") - F.expr(f"INTERVAL {runner.history_days} DAYS")).first()[0]
        touched = new.select("symbol").distinct()
        known = stage(read_bars(spark, cache, since=since).select(*BAR_COLUMNS), "known")
        seen = fills.groupBy("symbol").agg(F.max("ts").alias("seen"))
        judged = new.select("symbol", "ts").join(seen, "symbol", "left").filter("seen IS NULL OR ts > seen")
        said = stage(research.shadow_step(known.join(touched, "symbol", "left_semi"), s, model, runner, judged=judged), "said")
        kept = gated(said, opened.select("symbol", "side"), known, limits)
        kept.select(*(c.split()[0] for c in FILLS.split(", "))).write.mode("overwrite").parquet(f"{ledger}/fills/batch={batch_id}")
        every = fills.drop("batch").unionByName(spark.read.schema(FILLS).parquet(f"{ledger}/fills/batch={batch_id}"))
        trades, still = settle(every.filter("action = 'paper_fill'"), known, ended, s.backtest)
        trades.write.mode("overwrite").parquet(f"{ledger}/trades/batch={batch_id}")
        still.write.mode("overwrite").parquet(f"{ledger}/open/batch={batch_id}")


def shadow_ledger(
    bars: DataFrame, cache: str, ledger: str, checkpoint: str, settings: research.Settings | None = None, model: MetaModel | None = None,
    runner: RunnerConfig | None = None, limits: RiskLimits | None = None, once: bool = False, every: str = "30 seconds",
) -> StreamingQuery:
    """Runs ``shadow_batch`` for each micro-batch of closed bars. Symbols without enough bars yet are left out."""
    s, runner, limits = settings or research.Settings(), runner or RunnerConfig(), limits or RiskLimits()
    check_history(s, runner)
    write = lambda batch, batch_id: shadow_batch(batch, batch_id, cache, ledger, s, model, runner, limits)
    writer = bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def read_trades(spark: SparkSession, ledger: str, cfg: BacktestConfig | None = None) -> DataFrame:
    """The trades so far, with pnl and equity_after of each symbol's account."""
    cfg = cfg or BacktestConfig()
    order = Window.partitionBy("symbol").orderBy("entry_time")
    grown = backtest.compounded(F.col("size_frac") * F.col("net_ret"), order.rowsBetween(Window.unboundedPreceding, 0))
    df = spark.read.schema(f"{TRADES}, batch bigint").parquet(f"{ledger}/trades").drop("batch").withColumn("equity_after", cfg.starting_equity * grown)
    return df.withColumn("pnl", F.col("equity_after") - F.coalesce(F.lag("equity_after").over(order), F.lit(cfg.starting_equity)))
