"""Sampling and labelling: dollar bars, CUSUM events, volatility targets and triple barriers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.windows import by_time, bfill, ffill, rolling, row_no
from quillon.operators import machines
from quillon.operators import recursions as R
from quillon.operators.features import log_return

DAY_MICROS = 86_400_000_000


def dollar_bars(bars: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Bars that close as soon as turnover reaches the symbol's threshold (symbol, threshold).

    The excess is not carried on and the last, open bar is dropped; ts is that of the last row.
    """
    numbered = R.per_symbol(
        bars.join(thresholds, "symbol"), lambda p: {"bar_id": R.fill_numbers(p["turnover"], p["threshold"])}, {"bar_id": "bigint"}
    )
    return (
        numbered.filter("bar_id >= 0")
        .groupBy("symbol", "bar_id")
        .agg(
            F.max("ts").alias("last_ts"),
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("turnover").alias("turnover"),
        )
        .select("symbol", F.col("last_ts").alias("ts"), "open", "high", "low", "close", "volume", "turnover")
    )


def cusum_events(bars: DataFrame, h: float | None = None, lookback: int = 100, mult: float = 2.0, threshold: Column | None = None, streamed: bool = False) -> DataFrame:
    """(symbol, ts) where the cumulated log return passes the threshold: ``h``, or the column
    ``threshold``, or ``mult`` times its rolling deviation. Missing thresholds are taken from the
    rows before, else (which looks ahead) from those after. ``streamed``: a symbol's rows needn't fit in memory."""
    df = bars.select("*", log_return().alias("__r")).filter("__r IS NOT NULL")
    if h is not None:
        own = F.lit(float(h))
    elif threshold is not None:
        own = F.coalesce(ffill(threshold), bfill(threshold))
    else:
        own = bfill(rolling(F.stddev_samp, F.col("__r"), lookback, 20) * mult)
    df = df.select("symbol", "ts", "__r", own.alias("__h"))
    if streamed:
        return machines.run(df.withColumnsRenamed({"__r": "r", "__h": "h"}), "ts", machines.Cusum)
    flagged = R.per_symbol(df, lambda p: {"event": R.cusum_flags(p["__r"], p["__h"])}, {"event": "int"})
    return flagged.filter("event = 1").select("symbol", "ts")


def day_return(bars: DataFrame) -> Column:
    """close / close of the bar before the first bar within the last day - 1; NULL where there is none."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    before = Window.partitionBy("symbol").orderBy(micros).rangeBetween(Window.unboundedPreceding, -DAY_MICROS - 1)
    return F.col("close") / F.last("close").over(before) - 1


def daily_volatility(bars: DataFrame, span: int = 100) -> DataFrame:
    """(symbol, ts, target_vol): exponentially weighted deviation of returns over a day."""
    df = bars.withColumn("__r", day_return(bars))
    out = R.per_symbol(df, lambda p: {"target_vol": R.ewm_std(p["__r"], span, min(span, 20))}, {"target_vol": "double"})
    return out.select("symbol", "ts", "target_vol")


def vertical_barriers(bars: DataFrame, events: DataFrame, n: int = 48) -> DataFrame:
    """(symbol, ts, t1): the bar n rows after each event, or the last one."""
    last = F.last("ts").over(by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = bars.select("symbol", "ts", F.coalesce(F.lead("ts", n).over(by_time()), last).alias("t1"))
    return events.select("symbol", "ts").join(ends, ["symbol", "ts"])


def band_join(events: DataFrame, bars: DataFrame, width: int) -> DataFrame:
    """Each event (symbol, e, ...) with the bars (symbol, n, ...) of rows e to e + width.

    Rows are cut into blocks of width + 1, so that a path lies in two of them: an equi-join on symbol
    and block with the range as a residual, instead of comparing all pairs of a symbol.
    """
    size = width + 1
    block = F.floor(F.col("e") / size)
    left = events.withColumn("__block", F.explode(F.array(block, block + 1)))
    right = bars.withColumn("__block", F.floor(F.col("n") / size))
    near = (F.col("n") >= F.col("e")) & (F.col("n") <= F.col("e") + width)
    return left.join(right, ["symbol", "__block"]).filter(near).drop("__block")


def triple_barrier(
    bars: DataFrame, events: DataFrame, pt: float = 2.0, sl: float = 1.0, hold: int = 48, min_target: float = 0.0005
) -> DataFrame:
    """Labels of events (symbol, ts, target_vol[, side]): t1, ret, bin, pt, sl, side.

    ``bin`` is 1 if the return (times side) first reaches pt * target, -1 if -sl * target, 0 if
    neither within ``hold`` rows; on a tie the upper side counts. Events without a later bar have no
    label. Missing targets take the last known one, at least min_target.
    """
    numbered = bars.select("symbol", "ts", "close", row_no().alias("n"))
    if "side" not in events.columns:
        events = events.withColumn("side", F.lit(1.0))
    carried = F.last("target_vol", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    events = events.withColumn("__tv", F.greatest(F.coalesce(carried, F.lit(min_target)), F.lit(min_target)))
    starts = events.join(numbered, ["symbol", "ts"]).select(
        "symbol",
        "ts",
        F.coalesce(F.col("side").cast("double"), F.lit(1.0)).alias("side"),
        (pt * F.col("__tv")).alias("pt"),
        (-sl * F.col("__tv")).alias("sl"),
        F.col("close").alias("c0"),
        F.col("n").alias("e"),
    )
    path = band_join(starts, numbered.select("symbol", F.col("ts").alias("at"), "close", "n"), hold)
    path = path.withColumn("r", (F.col("close") / F.col("c0") - 1) * F.col("side"))
    point = F.struct("n", "at", "r")
    best = path.groupBy("symbol", "ts", "side", "pt", "sl").agg(
        F.min(F.when(F.col("r") >= F.col("pt"), point)).alias("up"),
        F.min(F.when(F.col("r") <= F.col("sl"), point)).alias("dn"),
        F.max(point).alias("end"),
        F.count(F.lit(1)).alias("rows"),
    )
    up_first = F.col("up").isNotNull() & (F.col("dn").isNull() | (F.col("up.n") <= F.col("dn.n")))
    hit = F.when(up_first, F.col("up")).when(F.col("dn").isNotNull(), F.col("dn")).otherwise(F.col("end"))
    label = F.when(up_first, 1.0).when(F.col("dn").isNotNull(), -1.0).otherwise(0.0)
    return best.filter("rows >= 2").select(
        "symbol", "ts", hit["at"].alias("t1"), hit["r"].alias("ret"), label.alias("bin"), "pt", "sl", "side"
    )


def meta_target(labels: DataFrame) -> DataFrame:
    """``labels`` with y: did the trade reach its target?"""
    return labels.withColumn("y", (F.col("bin") == 1).cast("int"))


