"""Bar sources: ticks to bars, the bar cache, raw API pages and synthetic series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume", "turnover"]
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, turnover double"


def lineitem_ticks(spark: SparkSession, sf_dir: str, symbol: str = "flag") -> DataFrame:
    """Ticks (symbol, ts, price, volume, turnover, tie) of lineitem. ``symbol``: "flag" or "ALL"."""
    name = F.col("l_returnflag") if symbol == "flag" else F.lit("ALL")
    tie = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        name.alias("symbol"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        (F.col("l_extendedprice") / F.expr("nullif(l_quantity, 0)")).alias("price"),
        F.col("l_quantity").cast("double").alias("volume"),
        F.col("l_extendedprice").cast("double").alias("turnover"),
        tie.alias("tie"),
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of events: symbol is the event type, price its value; every tick has volume 1."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("volume"),
        F.col("value").alias("turnover"),
        F.struct("ts", "event_id").alias("tie"),
    )


def time_bars(ticks: DataFrame, width: str) -> DataFrame:
    """OHLCV bars of fixed width. Ticks without a positive finite price are dropped.

    One partial aggregation; open and close are taken by the tie-break, so no sort is needed.
    """
    good = ticks.filter((F.col("price") > 0) & (F.col("price") < float("inf")))
    return (
        good.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", "tie").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "tie").alias("close"),
            F.sum("volume").alias("volume"),
            F.round(F.sum("turnover"), 2).alias("turnover"),
        )
        .select("symbol", F.col("w.start").alias("ts"), *BAR_COLUMNS[2:])
    )


def with_vwap_close(bars: DataFrame) -> DataFrame:
    """Bars whose close is the volume-weighted mean price, which makes for smoother series."""
    return bars.withColumn("close", F.col("turnover") / F.expr("nullif(volume, 0)"))


def clean(bars: DataFrame) -> DataFrame:
    """Missing numbers as NULL (never NaN or infinite), and turnover from close and volume if absent."""
    if "turnover" not in bars.columns:
        bars = bars.withColumn("turnover", F.col("close") * F.col("volume"))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c)
    return bars.select("symbol", "ts", *(finite(c) for c in BAR_COLUMNS[2:]))


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, since: dt.datetime | None = None) -> DataFrame:
    """Cached bars, partitioned by symbol; both filters reach the scan."""
    bars = spark.read.parquet(path)
    if symbols is not None:
        bars = bars.filter(F.col("symbol").isin(symbols))
    return bars if since is None else bars.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))


def merge_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both sets of bars, one row for each symbol and time; where both have it, the new one."""
    both = old.select(*BAR_COLUMNS, F.lit(0).alias("rank")).unionByName(new.select(*BAR_COLUMNS, F.lit(1).alias("rank")))
    values = F.struct(*BAR_COLUMNS[2:])
    best = both.groupBy("symbol", "ts").agg(F.max_by(values, F.struct("rank", *BAR_COLUMNS[2:])).alias("v"))
    return best.select("symbol", "ts", "v.*")


def one_of_each(bars: DataFrame) -> DataFrame:
    """One row for each symbol and time; of several the one with the largest values, in the columns' order."""
    best = bars.groupBy("symbol", "ts").agg(F.max(F.struct(*BAR_COLUMNS[2:])).alias("v"))
    return best.select("symbol", "ts", "v.*")


def append_bars(new: DataFrame, path: str) -> None:
    """Adds the bars that the cache at ``path`` doesn't have, one for each time (see ``one_of_each``). What is
    there stays: a cache is only appended to, whereas ``merge_bars`` prefers the new bars."""
    spark = new.sparkSession
    try:
        # only the new symbols' folders and what can be as late as the new bars is read
        span = new.agg(F.min("ts"), F.collect_set("symbol")).first()
        old = read_bars(spark, path, span[1], span[0]).select("symbol", "ts")
        new = new.join(old, ["symbol", "ts"], "left_anti")
    except Exception as error:  # noqa: BLE001  the first call finds no cache
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    one_of_each(new).write.mode("append").partitionBy("symbol").parquet(path)


def parse_pages(pages: DataFrame, page: str = "page") -> DataFrame:
    """Bars from raw API pages (symbol, JSON): lists of strings, newest first. A page whose retCode isn't
    0 is an error."""
    body = F.from_json(F.col(page), "retCode int, retMsg string, result struct<list: array<array<string>>>")
    checked = F.when(body["retCode"] == 0, body["result"]["list"]).otherwise(
        F.raise_error(F.concat(F.lit("page with retCode "), F.coalesce(body["retCode"].cast("string"), F.lit("none"))))
    )
    rows = pages.select("symbol", F.explode(checked).alias("r"))
    start = F.timestamp_millis(F.col("r")[0].cast("bigint")).cast("timestamp_ntz").alias("ts")
    values = [F.col("r")[i + 1].cast("double").alias(c) for i, c in enumerate(BAR_COLUMNS[2:])]
    return one_of_each(rows.select("symbol", start, *values))


def calendar_days(bars: DataFrame) -> DataFrame:
    """(symbol, day, turnover) for every day from a symbol's first to its last; empty days have 0."""
    day = F.window("ts", "1 day")["start"].alias("day")
    daily = bars.groupBy("symbol", day).agg(F.sum("turnover").alias("turnover"))
    span = daily.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select("symbol", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return days.join(daily, ["symbol", "day"], "left").select("symbol", "day", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def dollar_threshold(bars: DataFrame, parts: float = 50.0, floor: float = 1e5) -> DataFrame:
    """(symbol, threshold): median daily turnover / ``parts``, at least ``floor``."""
    return calendar_days(bars).groupBy("symbol").agg(F.greatest(F.median("turnover") / parts, F.lit(floor)).alias("threshold"))


def ordered(*more: str) -> Window:
    return Window.partitionBy("symbol", *more).orderBy("ts")


# --- synthetic series ----------------------------------------------------------------------------


def bars_from_returns(returns: np.ndarray, minutes: int, seed: int, start: float = 30_000.0, wick: float = 0.0015) -> pd.DataFrame:
    """Bars whose log closes are cumulated returns; opens are the closes before, wicks half-normal."""
    rng = np.random.default_rng(seed + 9001)
    close = start * np.exp(np.cumsum(returns))
    open_ = np.concatenate([[start], close[:-1]])
    up, down = (np.abs(rng.normal(0, wick, len(close))) for _ in range(2))
    volume = rng.uniform(80, 240, len(close))
    ts = pd.date_range("2024-01-01", periods=len(close), freq=f"{minutes}min")
    body = pd.DataFrame({"ts": ts, "open": open_, "close": close, "volume": volume, "turnover": close * volume})
    body["high"] = np.maximum(open_, close) * (1 + up)
    body["low"] = np.minimum(open_, close) * (1 - down)
    return body


#: Profiles: daily volatility, then segments (share, drift and volatility in units of the bar's).
PROFILES = {
    "major": (0.02, ((1, 0.15, 1.0), (1, 0.0, 0.7), (1, -0.15, 1.0), (1, 0.0, 1.4), (1, 0.1, 1.0), (1, 0.0, 1.0))),
    "directional": (0.03, ((1, 0.13, 1.0), (1, -0.13, 1.0), (1, 0.1, 1.1), (1, 0.0, 0.9))),
    "flipping": (0.05, tuple((1, 0.06 * (-1) ** i, 1.0) for i in range(8))),
    "ranging": (0.025, ((3, 0.0, 0.6), (1, 0.4, 1.0), (3, 0.0, 0.6), (1, -0.4, 1.0), (2, 0.0, 0.6))),
    "trending": (0.06, ((2, 0.12, 1.0), (1, -0.1, 1.0), (2, 0.12, 1.0), (1, -0.1, 1.0), (3, 0.12, 1.0))),
}


def synthetic(spark: SparkSession, profile: str, n_bars: int, minutes: int = 5, seed: int = 11) -> DataFrame:
    """A seeded regime-switching series as bars; its symbol is the profile's name."""
    pdf = _synthetic(profile, n_bars, minutes, seed)
    pdf.insert(0, "symbol", profile)
    return spark.createDataFrame(pdf[BAR_COLUMNS], BARS)


#: The robustness report's cells: bars by timeframe in minutes, each profile with each seed.
CELL_BARS = {5: 18_000, 15: 12_000, 60: 6_000, 240: 3_000}
CELL_SEEDS = (11, 23, 47)


def synthetic_cells(spark: SparkSession) -> DataFrame:
    """The series of all cells as bars, made by the workers; symbols are profile/minutes/seed."""
    cells = [(p, m, s) for p in PROFILES for m in CELL_BARS for s in CELL_SEEDS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for i in (i for batch in batches for i in batch["id"]):
            profile, minutes, seed = cells[i]
            pdf = _synthetic(profile, CELL_BARS[minutes], minutes, seed)
            pdf.insert(0, "symbol", f"{profile}/{minutes}/{seed}")
            yield pdf[BAR_COLUMNS]

    return spark.range(len(cells)).mapInPandas(run, BARS)


def _synthetic(profile: str, n_bars: int, minutes: int, seed: int) -> pd.DataFrame:
    daily, segments = PROFILES[profile]
    sd = daily / np.sqrt(24 * 60 / minutes)
    rng = np.random.default_rng(seed)
    edges = np.round(np.cumsum([0, *(s[0] for s in segments)]) / sum(s[0] for s in segments) * n_bars).astype(int)
    parts = [rng.normal(m * sd, v * sd, b - a) for (_, m, v), a, b in zip(segments, edges, edges[1:], strict=False)]
    return bars_from_returns(np.concatenate(parts), minutes, seed)


def returns_of(bars: DataFrame) -> Column:
    return F.ln("close") - F.lag(F.ln("close")).over(ordered())
