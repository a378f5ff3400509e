"""The registered queries over the TPC-H-like tables, each with DuckDB SQL where SQL can express it.

Prices of lineitem are independent draws, so that some queries use volume-weighted closes and wider
thresholds to have events of every kind. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import windows as W
from quillon.functions.blocks import Blocks
from quillon.operators import backtest, boosting, features, labels, long_series, meta, risk, signals, tpe, validation
from quillon.params import BacktestConfig, DriftConfig, MetaParams, PrimaryParams, RiskLimits
from quillon.plans import research
from quillon.plans.sqltext import (
    BARS,
    EVENT_BARS,
    LAG,
    PIVOTS,
    PREFIX,
    SIGNAL_INPUTS,
    TRUE_RANGE,
    VWAP,
    ewm,
    frame,
    lag,
    numbered,
    roll,
    with_atr,
    zscore,
)
from quillon.sources import bars as B
from quillon.sources import klines
from quillon.storage import shared_folder, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {sql}"
        return f

    return add


def as_in(name: str) -> Callable[[Query], Query]:
    """Registers another way to the rows of the query ``name``, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, ORACLES[name]
        return f

    return add


def daily(spark: SparkSession, d: str) -> DataFrame:
    return B.time_bars(B.lineitem_ticks(spark, d), "1 day")


def vwap(spark: SparkSession, d: str) -> DataFrame:
    return B.with_vwap_close(daily(spark, d))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return B.time_bars(B.event_ticks(spark, d), "1 hour")


def rounded(df: DataFrame, places: int, *columns: str, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    return df.select(*keys, *(F.round(c, places).alias(c) for c in columns))


def r(places: int, *columns: str) -> str:
    """SQL: the columns rounded under their own names; "a=b" rounds expression b as a."""
    parts = (c.partition("=") for c in columns)
    return ", ".join(f"round({b or a}, {places}) AS {a}" for a, _, b in parts)


# --- sources -------------------------------------------------------------------------------------


@query("x AS (SELECT 1) SELECT l_returnflag AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate >= TIMESTAMP '1997-01-01'")
def q01_bar_scan_pruned(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit("1997-01-01").cast("timestamp_ntz")
    return B.lineitem_ticks(spark, d).filter((F.col("symbol") == "A") & (F.col("ts") >= since)).select("symbol", "ts", "price")


@query(f"{BARS}, n AS (SELECT *, ts < TIMESTAMP '1995-01-01' AS o, ts >= TIMESTAMP '1994-01-01' AS w FROM bars) SELECT symbol, ts, CASE WHEN w THEN close ELSE close + 1 END AS close FROM n WHERE o OR w")
def q02_cache_merge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    bars = daily(spark, d)
    old = bars.filter(F.col("ts") < F.lit("1995-01-01").cast("timestamp_ntz")).withColumn("close", F.col("close") + 1)
    new = bars.filter(F.col("ts") >= F.lit("1994-01-01").cast("timestamp_ntz"))
    return B.merge_bars(old, new).select("symbol", "ts", "close")


@query(f"{BARS} SELECT symbol, ts, open, high, low, close, volume, turnover FROM bars")
def q03_ohlcv_time_bars(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d)


@query(f"{EVENT_BARS} SELECT symbol, ts, {r(4, 'open', 'high', 'low', 'close', 'volume')} FROM bars")
def q04_event_hour_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hourly(spark, d), 4, "open", "high", "low", "close", "volume")


@as_in("q04_event_hour_bars")
def q07_kline_source(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of the events, kept as raw pages and paged through by the kline source."""
    klines.register(spark)
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    bars = stage(hourly(spark, d), "hourly")
    klines.write_pages(bars, path)
    first, last, symbols = bars.agg(F.min("ts"), F.max("ts"), F.collect_set("symbol")).first()
    ms = lambda t: str(int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1000))
    options = {"folder": path, "symbols": ",".join(sorted(symbols)), "interval": "60", "start": ms(first), "end": ms(last + dt.timedelta(hours=1)), "pause": "0", "wait": "0.1"}
    return rounded(spark.read.format("klines").options(**options).load(), 4, "open", "high", "low", "close", "volume")


@query(f"{EVENT_BARS} SELECT symbol, ts, open, high, low, close, volume, turnover FROM bars")
def q05_api_page_normaliser(spark: SparkSession, d: str) -> DataFrame:
    """Bars as raw pages of 200 rows, newest first, and back."""
    bars = hourly(spark, d).withColumn("page", F.floor((F.row_number().over(W.by_time()) - 1) / 200))
    text = [F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), *(F.col(c).cast("string") for c in B.BAR_COLUMNS[2:])]
    listed = F.sort_array(F.collect_list(F.struct("ts", F.array(*text).alias("r"))), asc=False)
    pages = bars.groupBy("symbol", "page").agg(F.transform(listed, lambda x: x["r"]).alias("list"))
    body = F.to_json(F.struct(F.lit(0).alias("retCode"), F.struct("list").alias("result")))
    return B.parse_pages(pages.select("symbol", body.alias("page")))


@query()
def q06_synthetic_bars(spark: SparkSession, d: str) -> DataFrame:
    """The robustness report's 60 series: 585,000 bars."""
    return B.synthetic_cells(spark)


@query(f"""{BARS}, a AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY symbol),
c AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM a)
SELECT symbol, round(greatest(median(coalesce(turnover, 0)) / 50, 100000.0), 4) AS threshold FROM c LEFT JOIN bars USING (symbol, ts) GROUP BY symbol""")
def q10_dollar_threshold_daily_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.dollar_threshold(daily(spark, d)), 4, "threshold", keys=("symbol",))


# --- windows and features ------------------------------------------------------------------------

_RET = f"r AS MATERIALIZED (SELECT *, ln(close) - {lag('ln(close)')} AS log_ret FROM bars)"


@query(f"{BARS}, {_RET} SELECT symbol, ts, {r(8, 'log_ret')} FROM r")
def q11_log_returns_lag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.add_returns(daily(spark, d)), 8, "log_ret")


@query(f"{BARS}, {_RET} SELECT symbol, ts, round({roll('stddev_samp', 'log_ret', 20)}, 6) AS vol_20, round({roll('stddev_samp', 'log_ret', 64)}, 6) AS vol_64 FROM r")
def q12_rolling_vol_min_periods(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.add_returns(daily(spark, d)), 6, "vol_20", "vol_64")


@query(f"{BARS} SELECT symbol, ts, round({zscore('close')}, 6) AS price_z FROM bars")
def q13_rolling_zscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.add_returns(daily(spark, d)), 6, "price_z")


@query(f"{BARS}, {numbered('s', 'close')}, {ewm('e', 's', {'y': ('close', 2 / 21)})} SELECT symbol, ts, CASE WHEN n >= 20 THEN round(y, 4) END AS ema20 FROM e JOIN s USING (symbol, n)")
def q14_ema(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.add_emas(daily(spark, d), (20,)), 4, "ema20")


@query(f"{BARS}, {with_atr()} SELECT symbol, ts, {r(4, 'atr_14')} FROM atr")
def q15_atr_wilder(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.add_atr(daily(spark, d)), 4, "atr_14")


_EMAS = {f"y{n}": ("close", 2 / (n + 1)) for n in (20, 50, 200)}


def _slope(n: int, k: int) -> str:
    return f"(ema{n} - {lag(f'ema{n}', k)}) / nullif({lag(f'ema{n}', k)}, 0) AS ema{n}_slope"


@query(f"""{BARS}, {numbered('s', 'close')}, {ewm('e', 's', _EMAS)},
g AS (SELECT symbol, ts, close, {', '.join(f'CASE WHEN n >= {n} THEN y{n} END AS ema{n}' for n in (20, 50, 200))} FROM e JOIN s USING (symbol, n)),
h AS (SELECT *, {_slope(20, 5)}, {_slope(50, 10)}, {_slope(200, 20)},
  (coalesce(sign(ema20 - ema50), 0) + coalesce(sign(ema50 - ema200), 0) + coalesce(sign(close - ema200), 0)) / 3.0 AS trend_align FROM g)
SELECT symbol, ts, {r(6, 'ema20_slope', 'ema50_slope', 'ema200_slope', 'trend_align')} FROM h""")
def q16_ema_stack(spark: SparkSession, d: str) -> DataFrame:
    df = features.add_ema_stack(features.add_emas(daily(spark, d)))
    return rounded(df, 6, "ema20_slope", "ema50_slope", "ema200_slope", "trend_align")


@query(f"""{BARS}, {numbered('m', f"{TRUE_RANGE} AS tr, high - {lag('high')} AS up, {lag('low')} - low AS dn")},
s AS MATERIALIZED (SELECT *, CASE WHEN up IS NULL THEN NULL WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pm, CASE WHEN up IS NULL THEN NULL WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mm FROM m),
{ewm('e', 's', {'a': ('tr', 1 / 14), 'p': ('pm', 1 / 14), 'q': ('mm', 1 / 14)})},
g AS (SELECT symbol, n, CASE WHEN n >= 15 THEN 100 * p / nullif(a, 0) END AS plus_di, CASE WHEN n >= 15 THEN 100 * q / nullif(a, 0) END AS minus_di FROM e),
x AS MATERIALIZED (SELECT *, coalesce(100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0), 0.0) AS dx FROM g),
{ewm('f', 'x', {'y': ('dx', 1 / 14)})}
SELECT symbol, ts, round(CASE WHEN n >= 14 THEN y END, 5) AS adx, {r(5, 'plus_di', 'minus_di')}, round(plus_di - minus_di, 5) AS di_spread
FROM f JOIN x USING (symbol, n) JOIN s USING (symbol, n)""")
def q17_adx(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.add_adx(daily(spark, d)), 5, "adx", "plus_di", "minus_di", "di_spread")


@query(f"""{BARS}, {numbered('c', f"close - {lag('close')} AS ch")}, s AS MATERIALIZED (SELECT *, greatest(ch, 0) + 0 * ch AS gain, -least(ch, 0) + 0 * ch AS loss FROM c),
{ewm('e', 's', {'g': ('gain', 1 / 14), 'l': ('loss', 1 / 14)})}
SELECT symbol, ts, round(CASE WHEN n >= 15 THEN 100 - 100 / (1 + g / nullif(l, 0)) END, 5) AS rsi_14 FROM e JOIN s USING (symbol, n)""")
def q18_rsi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.add_rsi(daily(spark, d)), 5, "rsi_14")


@query(f"""{BARS}, a AS (SELECT *, {roll('avg', 'close', 20, 10)} AS bb_mid, {roll('stddev_pop', 'close', 20, 10)} AS sd FROM bars),
b AS (SELECT *, bb_mid + 2 * sd AS bb_upper, bb_mid - 2 * sd AS bb_lower FROM a)
SELECT symbol, ts, {r(3, 'bb_mid', 'bb_upper', 'bb_lower')}, {r(6, 'bb_width=(bb_upper - bb_lower) / nullif(bb_mid, 0)', 'bb_pct_b=(close - bb_lower) / nullif(bb_upper - bb_lower, 0)', 'bb_z=(close - bb_mid) / nullif(sd, 0)')} FROM b""")
def q19_bollinger(spark: SparkSession, d: str) -> DataFrame:
    df = features.add_bollinger(daily(spark, d))
    return df.select("symbol", "ts", *(F.round(c, 3).alias(c) for c in ("bb_mid", "bb_upper", "bb_lower")), *(F.round(c, 6).alias(c) for c in ("bb_width", "bb_pct_b", "bb_z")))


def _runs(flag: str, name: str, source: str, out: str) -> str:
    return f"""{name}0 AS (SELECT *, CASE WHEN lag({flag}) OVER {LAG} IS NULL OR {flag} <> lag({flag}) OVER {LAG} THEN 1 ELSE 0 END AS ch FROM {source}),
{name}1 AS (SELECT *, sum(ch) OVER {PREFIX} AS run FROM {name}0),
{name} AS (SELECT * EXCLUDE (ch, run), CASE WHEN {flag} = 1 THEN row_number() OVER (PARTITION BY symbol, run ORDER BY ts) ELSE 0 END AS {out} FROM {name}1)"""


@query(f"""{BARS}, a AS (SELECT *, {roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi FROM bars),
b AS (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS kf FROM a), c AS (SELECT *, {roll('avg', 'kf', 3)} AS ks FROM b),
d0 AS (SELECT *, ks - ({roll('avg', 'ks', 3)}) AS spread, CASE WHEN ks < 20 THEN 1 ELSE 0 END AS os, CASE WHEN ks > 80 THEN 1 ELSE 0 END AS ob FROM c),
{_runs('os', 'p', 'd0', 'osd')}, {_runs('ob', 'q', 'p', 'obd')}
SELECT symbol, ts, {r(6, 'stoch_k=ks / 100', 'stoch_spread=spread')}, CAST(osd AS DOUBLE) AS stoch_oversold_dur, CAST(obd AS DOUBLE) AS stoch_overbought_dur FROM q""")
def q20_stochastic(spark: SparkSession, d: str) -> DataFrame:
    df = features.add_stochastic(daily(spark, d))
    return df.select("symbol", "ts", *(F.round(c, 6).alias(c) for c in ("stoch_k", "stoch_spread")), "stoch_oversold_dur", "stoch_overbought_dur")


@query(f"""{BARS}, {with_atr()}, a AS (SELECT *, {roll('max', 'high', 20)} AS up, {roll('min', 'low', 20)} AS dn FROM atr),
b AS (SELECT *, {lag('up')} AS up1, {lag('dn')} AS dn1, {lag('close')} AS c1 FROM a)
SELECT symbol, ts, {r(6, 'donch_pos=(close - dn) / nullif(up - dn, 0)', 'donch_width_atr=(up - dn) / nullif(atr_14, 0)', 'donch_break_strength=(close - up1) / nullif(atr_14, 0)', 'donch_mid_dist_atr=(close - (up + dn) / 2) / nullif(atr_14, 0)')},
  CASE WHEN close > up1 AND c1 <= up1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS donch_break_up, CASE WHEN close < dn1 AND c1 >= dn1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS donch_break_dn FROM b""")
def q21_donchian(spark: SparkSession, d: str) -> DataFrame:
    df = features.add_donchian(features.add_atr(daily(spark, d)))
    some = ("donch_pos", "donch_width_atr", "donch_break_strength", "donch_mid_dist_atr")
    return df.select("symbol", "ts", *(F.round(c, 6).alias(c) for c in some), "donch_break_up", "donch_break_dn")


@query(f"{BARS}, a AS (SELECT symbol, ts, CASE WHEN close > {lag('close')} THEN 1 ELSE 0 END AS up FROM bars), {_runs('up', 'p', 'a', 'run_length')} SELECT symbol, ts, CAST(run_length AS DOUBLE) AS run_length FROM p")
def q22_run_lengths(spark: SparkSession, d: str) -> DataFrame:
    df = features._run_lengths(daily(spark, d).withColumn("c1", features.lag("close")), {"run_length": F.col("close") > F.col("c1")})
    return df.select("symbol", "ts", "run_length")


@query(f"""{BARS}, {numbered('s', 'close')}, {ewm('e', 's', {'f': ('close', 2 / 13), 'g': ('close', 2 / 27)})},
m AS MATERIALIZED (SELECT symbol, n, CASE WHEN n >= 26 THEN f - g END AS macd FROM e), {ewm('h', 'm', {'y': ('macd', 2 / 10)})},
a AS (SELECT symbol, ts, close, macd, CASE WHEN n >= 34 THEN y END AS sig FROM h JOIN m USING (symbol, n) JOIN s USING (symbol, n)),
b AS (SELECT *, macd - sig AS hist FROM a),
c AS (SELECT *, {zscore('hist')} AS hz, {zscore('close')} AS pz, hist - {lag('hist')} AS slope, {lag('macd')} AS m1, {lag('sig')} AS s1 FROM b)
SELECT symbol, ts, {r(5, 'macd_hist_z=hz', 'macd_divergence=coalesce(pz - hz, 0.0)')}, round(slope, 3) AS macd_hist_slope,
  CASE WHEN macd > sig AND m1 <= s1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS macd_cross_up, CASE WHEN macd < sig AND m1 >= s1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS macd_cross_dn FROM c""")
def q23_macd(spark: SparkSession, d: str) -> DataFrame:
    df = features.add_macd(daily(spark, d))
    return df.select("symbol", "ts", *(F.round(c, 5).alias(c) for c in ("macd_hist_z", "macd_divergence")), F.round("macd_hist_slope", 3).alias("macd_hist_slope"), "macd_cross_up", "macd_cross_dn")


@query(f"""{BARS}, {numbered('s', f"CASE WHEN close > 1.5 * {lag('close')} THEN 1.0 ELSE 0.0 END AS x")},
e AS (SELECT symbol, n, CAST(x AS DOUBLE) AS y FROM s WHERE n = 1 UNION ALL SELECT s.symbol, s.n, e.y * 0.9 + s.x FROM e JOIN s ON s.symbol = e.symbol AND s.n = e.n + 1)
SELECT symbol, ts, round(y, 6) AS hawkes_intensity FROM e JOIN s USING (symbol, n)""")
def q24_hawkes(spark: SparkSession, d: str) -> DataFrame:
    bars = daily(spark, d).withColumn("c1", features.lag("close"))
    return rounded(features.add_hawkes(bars, 0.1, events=W.flag(F.col("close") > 1.5 * F.col("c1"))), 6, "hawkes_intensity")


def _frac_diff_sql(weights: np.ndarray) -> str:
    n = len(weights)
    return f"{BARS}, a AS (SELECT symbol, ts, list(close) OVER {frame(f'{n - 1} PRECEDING')} AS v FROM bars) SELECT symbol, ts, CASE WHEN len(v) = {n} THEN round(list_dot_product(v, {[float(w) for w in weights]}::DOUBLE[]), 4) END AS ffd FROM a"


@query(_frac_diff_sql(features.R.ffd_weights(0.8, 1e-3)))
def q25_frac_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.add_frac_diff(daily(spark, d), 0.8, 1e-3), 4, "ffd")


@query(_frac_diff_sql(features.R.ffd_weights(0.4)))
def q25_frac_diff_all(spark: SparkSession, d: str) -> DataFrame:
    """The operator's own order and threshold: 1,458 weights."""
    return rounded(features.add_frac_diff(daily(spark, d)), 4, "ffd")


@query()
def q26_min_stationary_d(spark: SparkSession, d: str) -> DataFrame:
    return features.min_stationary_d(daily(spark, d))


@query()
def q34_hmm_regime(spark: SparkSession, d: str) -> DataFrame:
    return features.add_hmm_regime(features.add_returns(vwap(spark, d))).select("symbol", "ts", "regime")


def _regime_inputs(bars: DataFrame) -> DataFrame:
    """Stand-ins that both engines can compute."""
    w = W.by_time()
    df = bars.withColumns({"n": F.row_number().over(w), "bb_width": (F.col("high") - F.col("low")) / F.col("close"), "mid": F.avg("close").over(W.last_rows(200))})
    df = df.withColumn("trend_align", F.when(F.floor(F.col("n") / 60) % 3 == 0, 1.0).when(F.floor(F.col("n") / 60) % 3 == 1, -2.0 / 3).otherwise(0.0))
    return df.withColumns({"adx": (F.col("n") % 45).cast("double"), "atr_pct": F.abs(F.col("close") - F.col("mid")) / F.col("mid")})


def _rank_sql(x: str) -> str:
    return f"CASE WHEN len(l_{x}) >= 50 THEN (len(list_filter(l_{x}, lambda v: v < {x})) + (len(list_filter(l_{x}, lambda v: v = {x})) + 1) / 2.0) / len(l_{x}) END"


@query(f"""{BARS}, i AS (SELECT *, row_number() OVER {LAG} AS n, (high - low) / close AS bb_width, avg(close) OVER {frame('199 PRECEDING')} AS mid FROM bars),
j AS (SELECT *, CASE WHEN (n // 60) % 3 = 0 THEN 1.0 WHEN (n // 60) % 3 = 1 THEN -2.0::DOUBLE / 3 ELSE 0.0 END AS ta, CAST(n % 45 AS DOUBLE) AS adx, abs(close - mid) / mid AS atr_pct FROM i),
k AS (SELECT *, list(bb_width) OVER {frame('249 PRECEDING')} AS l_bb_width, list(atr_pct) OVER {frame('249 PRECEDING')} AS l_atr_pct, CAST(sign(ta) AS DOUBLE) AS sg FROM j),
m AS (SELECT * EXCLUDE (l_bb_width, l_atr_pct), {_rank_sql('bb_width')} AS wp, {_rank_sql('atr_pct')} AS ap, CASE WHEN lag(sg) OVER {LAG} IS NULL OR sg <> lag(sg) OVER {LAG} THEN 1 ELSE 0 END AS ch FROM k),
o AS (SELECT *, sum(ch) OVER {PREFIX} AS run FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) >= 30 AS lng FROM o),
q AS (SELECT *, adx >= 32 AND abs(ta) >= 1 AND lng AS st, adx >= 25 AND abs(ta) >= 2.0::DOUBLE / 3 AND lng AS wk, coalesce((adx <= 22 OR abs(ta) <= 1.0::DOUBLE / 3) AND wp <= 0.75, false) AS qu,
  coalesce(adx <= 16 AND wp <= 0.2 AND ap <= 0.3, false) OR coalesce(adx <= 20 AND ap >= 0.85 AND NOT lng, false) AS chp FROM p),
z AS (SELECT *, CASE WHEN qu THEN 0.0 WHEN st THEN 2 * sg WHEN wk THEN sg ELSE 0.0 END AS code FROM q)
SELECT symbol, ts, CAST(code AS DOUBLE) AS regime_code, CAST(code > 0 AS INT)::DOUBLE AS is_trend_up, CAST(code < 0 AS INT)::DOUBLE AS is_trend_dn, CAST(qu AND NOT wk AND NOT st AND NOT chp AS INT)::DOUBLE AS is_range,
  CAST(chp AS INT)::DOUBLE AS is_chop, round(wp, 6) AS bb_width_pctl FROM z""")
def q27_regime_score_pct_rank(spark: SparkSession, d: str) -> DataFrame:
    df = features.add_regime_score(_regime_inputs(daily(spark, d)))
    return df.select("symbol", "ts", "regime_code", "is_trend_up", "is_trend_dn", "is_range", "is_chop", F.round("bb_width_pctl", 6).alias("bb_width_pctl"))


_ZIGZAG = f"""{with_atr()}, zs AS MATERIALIZED (SELECT symbol, n, ts, high, low, close, first_value(atr_14 IGNORE NULLS) OVER {frame('CURRENT ROW', 'UNBOUNDED FOLLOWING')} AS rev FROM atr),
zz AS (
  SELECT symbol, n, 0 AS leg, close AS best, n AS pv, CAST(NULL AS BIGINT) AS up_pv, CAST(NULL AS DOUBLE) AS up_price, CAST(NULL AS BIGINT) AS dn_pv, CAST(NULL AS DOUBLE) AS dn_price
  FROM zs WHERE n = 1
  UNION ALL
  SELECT symbol, n, CASE WHEN turn2 THEN 1 ELSE leg END, CASE WHEN ext2 THEN low WHEN turn2 THEN high ELSE best END, CASE WHEN ext2 OR turn2 THEN n ELSE pv END,
         up_pv, up_price, CASE WHEN turn2 THEN pv END, CASE WHEN turn2 THEN best END
  FROM (
    SELECT *, coalesce(leg <> 1 AND low < best, false) AS ext2, coalesce(leg <> 1 AND NOT low < best AND high - best > rev, false) AS turn2
    FROM (
      SELECT symbol, n, high, low, rev, CASE WHEN turn1 THEN -1 ELSE leg END AS leg, CASE WHEN ext1 THEN high WHEN turn1 THEN low ELSE best END AS best,
             CASE WHEN ext1 OR turn1 THEN n ELSE pv END AS pv, CASE WHEN turn1 THEN pv END AS up_pv, CASE WHEN turn1 THEN best END AS up_price
      FROM (
        SELECT s.*, z.leg, z.best, z.pv, z.leg <> -1 AND s.high > z.best AS ext1, coalesce(z.leg <> -1 AND NOT s.high > z.best AND z.best - s.low > s.rev, false) AS turn1
        FROM zz z JOIN zs s ON s.symbol = z.symbol AND s.n = z.n + 1
      )
    )
  )
), zf AS (
  SELECT symbol, n, up_pv AS pv, up_price AS price, 1 AS kind FROM zz WHERE up_pv IS NOT NULL
  UNION ALL SELECT symbol, n, dn_pv, dn_price, -1 FROM zz WHERE dn_pv IS NOT NULL
)"""


@query(f"""{EVENT_BARS}, {_ZIGZAG}, zo AS (SELECT *, row_number() OVER (PARTITION BY symbol, pv ORDER BY n, kind DESC) AS k FROM zf)
SELECT o.symbol, a.ts, c.ts AS confirmed, o.price, o.kind FROM zo o JOIN zs a ON a.symbol = o.symbol AND a.n = o.pv JOIN zs c ON c.symbol = o.symbol AND c.n = o.n WHERE k = 1""")
def q28_zigzag(spark: SparkSession, d: str) -> DataFrame:
    return features.zigzag_pivots(features.add_atr(hourly(spark, d)), 1.0)


def _extremes(bars: DataFrame) -> DataFrame:
    around = W.by_time().rowsBetween(-2, 2)
    kind = F.when(F.col("high") == F.max("high").over(around), 1).when(F.col("low") == F.min("low").over(around), -1)
    df = bars.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("k1", F.lag("kind").over(W.by_time()))
    df = df.filter("k1 IS NULL OR kind <> k1")
    return df.select("symbol", "ts", F.col("ts").alias("confirmed"), F.when(F.col("kind") == 1, F.col("high")).otherwise(F.col("low")).alias("price"), "kind")


_AT = """ao AS (SELECT b.*, p.* EXCLUDE (symbol, ts) FROM bars b ASOF LEFT JOIN pl p ON b.symbol = p.symbol AND b.ts >= p.ts)"""


@query(f"""{BARS}, {PIVOTS}, pl AS (SELECT symbol, ts, price AS p1, lag(price) OVER {LAG} AS p0 FROM piv), {_AT},
a AS (SELECT *, greatest(high - low, 1.0) AS a, p1 - p0 AS rng FROM ao),
lv AS (SELECT symbol, ts, min_by(lvl, {{'d': d, 'l': lvl}}) AS lvl, min(d) AS d FROM (
  SELECT symbol, ts, lvl, abs(p1 - lvl * rng - close) / a AS d FROM (SELECT *, unnest([0.236, 0.382, 0.5, 0.618, 0.786]::DOUBLE[]) AS lvl FROM a WHERE rng <> 0)) GROUP BY ALL)
SELECT a.symbol, a.ts, round(coalesce(d, 999), 5) AS fib_nearest_dist_atr, coalesce(lvl, 0.5::DOUBLE) AS fib_nearest_level,
  CASE WHEN rng <> 0 AND close BETWEEN least(p1 - 0.618 * rng, p1 - 0.5 * rng) AND greatest(p1 - 0.618 * rng, p1 - 0.5 * rng) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fib_in_golden_zone
FROM a LEFT JOIN lv ON a.symbol = lv.symbol AND a.ts = lv.ts""")
def q29_fibonacci(spark: SparkSession, d: str) -> DataFrame:
    bars = daily(spark, d)
    df = features.add_fibonacci(bars.withColumn("span", F.greatest(F.col("high") - F.col("low"), F.lit(1.0))), _extremes(bars), atr="span")
    return df.select("symbol", "ts", F.round("fib_nearest_dist_atr", 5).alias("fib_nearest_dist_atr"), "fib_nearest_level", "fib_in_golden_zone")


@query(f"""{BARS}, {PIVOTS}, pl AS (SELECT symbol, ts, row_number() OVER {LAG} AS j, price AS p5, {', '.join(f'lag(price, {5 - i}) OVER {LAG} AS p{i}' for i in range(5))}, lag(kind, 5) OVER {LAG} AS k0 FROM piv), {_AT},
a AS (SELECT symbol, ts, j, p0, p3, CASE WHEN k0 = -1 THEN 1 ELSE -1 END AS dr, p1 - p0 AS a1, p1 - p2 AS a2, p3 - p2 AS a3, p3 - p4 AS a4, p5 - p4 AS a5 FROM ao),
b AS (SELECT *, a1 * dr AS w1, a2 * dr AS w2, a3 * dr AS w3, a4 * dr AS w4, a5 * dr AS w5 FROM a),
c AS (SELECT *, CASE WHEN least(w1, w2, w3, w4, w5) > 0 AND p0 IS NOT NULL THEN (CAST(w2 / w1 BETWEEN 0.382 AND 0.786 AS INT) + CAST(w3 >= 1.618 * w1 AS INT) + CAST(w3 >= w1 AND w3 >= w5 AS INT)
  + CAST((p3 - dr * w4 - p0 - dr * w1) * dr > 0 AS INT) + CAST(w5 / w1 BETWEEN 0.382 AND 1.618 AS INT)) / 5.0::DOUBLE ELSE 0.0 END AS conf FROM b)
SELECT symbol, ts, CASE WHEN conf >= 0.6 THEN 5 ELSE 0 END AS ew_wave_id, CAST(conf AS DOUBLE) AS ew_confidence, CASE WHEN conf >= 0.6 AND (j - 1) % 5 = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ew_in_wave3,
  CASE WHEN conf >= 0.6 AND (j - 1) % 5 = 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ew_in_wave5 FROM c""")
def q30_elliott(spark: SparkSession, d: str) -> DataFrame:
    bars = daily(spark, d)
    return features.add_elliott(bars, _extremes(bars)).select("symbol", "ts", "ew_wave_id", "ew_confidence", "ew_in_wave3", "ew_in_wave5")


_LX = np.log(np.arange(2, 64))
_LC = (_LX - _LX.mean()) / ((_LX - _LX.mean()) ** 2).sum()


@query(f"""{BARS}, a AS (SELECT symbol, ts, row_number() OVER {LAG} AS n, {', '.join(f'close - {lag("close", k)} AS d{k}' for k in range(2, 64))} FROM bars),
b AS (SELECT symbol, ts, n, {', '.join(f'stddev_pop(d{k}) OVER {frame(f"{256 - k} PRECEDING", "1 PRECEDING")} AS t{k}' for k in range(2, 64))} FROM a)
SELECT symbol, ts, CASE WHEN n > 256 THEN round({' + '.join(f'{c!r} * ln(t{k})' for k, c in zip(range(2, 64), map(float, _LC), strict=True))}, 6) END AS hurst FROM b""")
def q31_rolling_hurst(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.add_hurst(daily(spark, d)), 6, "hurst")


@query(f"""{BARS}, {_RET}, v AS (SELECT symbol, ts, {roll('stddev_samp', 'coalesce(log_ret, 0)', 64)} AS v FROM r), w AS (SELECT *, round(v, 12) AS x FROM v),
q AS (SELECT symbol, ts, (rank() OVER (PARTITION BY symbol ORDER BY v) + (count(*) OVER (PARTITION BY symbol, v) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol) AS q FROM w WHERE v IS NOT NULL)
SELECT bars.symbol, bars.ts, CASE WHEN q <= 0.33 THEN 0.0::DOUBLE WHEN q <= 0.66 THEN 1.0::DOUBLE WHEN q <= 1.01 THEN 2.0::DOUBLE END AS regime FROM bars LEFT JOIN q USING (symbol, ts)""")
def q32_vol_quantile_regime(spark: SparkSession, d: str) -> DataFrame:
    return features.add_vol_regime(features.add_returns(daily(spark, d))).select("symbol", "ts", "regime")


@query()
def q33_feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_matrix(daily(spark, d))


# --- sampling and labels -------------------------------------------------------------------------


@query(f"""{BARS}, {numbered('s', 'open, high, low, close, volume, turnover, 5 * median(turnover) OVER (PARTITION BY symbol) AS thr')},
e AS (SELECT symbol, n, turnover AS cum, 0 AS id, turnover >= thr AS done FROM s WHERE n = 1
  UNION ALL SELECT s.symbol, s.n, CASE WHEN e.done THEN s.turnover ELSE e.cum + s.turnover END, e.id + CAST(e.done AS INT), CASE WHEN e.done THEN s.turnover ELSE e.cum + s.turnover END >= s.thr
  FROM e JOIN s ON s.symbol = e.symbol AND s.n = e.n + 1)
SELECT symbol, max(ts) AS ts, arg_min(open, n) AS open, max(high) AS high, min(low) AS low, arg_max(close, n) AS close, round(sum(volume), 2) AS volume
FROM e JOIN s USING (symbol, n) GROUP BY symbol, id HAVING bool_or(done)""")
def q40_dollar_bars(spark: SparkSession, d: str) -> DataFrame:
    bars = daily(spark, d)
    limits = bars.groupBy("symbol").agg((5 * F.median("turnover")).alias("threshold"))
    df = labels.dollar_bars(bars, limits)
    return df.select("symbol", "ts", "open", "high", "low", "close", F.round("volume", 2).alias("volume"))


def _sides(bars: DataFrame) -> DataFrame:
    mid = W.rolling(F.avg, F.col("close"), 20)
    return bars.withColumn("mid", mid).withColumn("primary_side", F.when(F.col("close") > F.col("mid"), 1).when(F.col("close") < F.col("mid"), -1).otherwise(0))


_SIDES = f"sd AS MATERIALIZED (SELECT *, CASE WHEN close > mid THEN 1 WHEN close < mid THEN -1 ELSE 0 END AS side FROM (SELECT *, {roll('avg', 'close', 20)} AS mid FROM bars))"


@query(f"{VWAP}, {_SIDES}, o AS (SELECT *, coalesce(lag(side) OVER {LAG}, 0) AS s1 FROM sd) SELECT symbol, ts, side AS primary_side FROM o WHERE side <> 0 AND side <> s1")
def q41_signal_onsets(spark: SparkSession, d: str) -> DataFrame:
    return signals.onsets(_sides(vwap(spark, d))).select("symbol", "ts", "primary_side")


_CUSUM = f"""{_RET}, c0 AS (SELECT symbol, ts, log_ret AS x FROM r WHERE log_ret IS NOT NULL), c1 AS (SELECT *, 2.0 * ({roll('stddev_samp', 'x', 100, 20)}) AS h0 FROM c0),
{numbered('cs', f"x, first_value(h0 IGNORE NULLS) OVER {frame('CURRENT ROW', 'UNBOUNDED FOLLOWING')} AS h", 'c1')},
cu AS (SELECT symbol, n, CASE WHEN greatest(0, x) > h THEN 0.0 ELSE greatest(0, x) END AS up, CASE WHEN greatest(0, x) <= h AND least(0, x) < -h THEN 0.0 ELSE least(0, x) END AS dn, greatest(0, x) > h OR least(0, x) < -h AS ev FROM cs WHERE n = 1
  UNION ALL SELECT symbol, n, CASE WHEN u > h THEN 0.0 ELSE u END, CASE WHEN u <= h AND w < -h THEN 0.0 ELSE w END, u > h OR w < -h
  FROM (SELECT s.symbol, s.n, s.h, greatest(0, cu.up + s.x) AS u, least(0, cu.dn + s.x) AS w FROM cu JOIN cs s ON s.symbol = cu.symbol AND s.n = cu.n + 1)),
ev AS MATERIALIZED (SELECT symbol, ts FROM cu JOIN cs USING (symbol, n) WHERE ev)"""


@query(f"{VWAP}, {_CUSUM} SELECT symbol, ts FROM ev")
def q42_cusum_events(spark: SparkSession, d: str) -> DataFrame:
    return labels.cusum_events(vwap(spark, d))


def _label_events(bars: DataFrame) -> DataFrame:
    """Every bar, with 20-bar deviation over mean as target."""
    df = bars.withColumns({"m": W.rolling(F.avg, F.col("close"), 20), "s": W.rolling(F.stddev_samp, F.col("close"), 20)})
    return df.filter(F.col("s").isNotNull()).select("symbol", "ts", (F.col("s") / F.col("m")).alias("target_vol"))


_LABELS = f"""nb AS MATERIALIZED (SELECT symbol, ts, close, row_number() OVER {LAG} AS n, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM bars),
evs AS (SELECT symbol, ts, n AS e, close AS c0, 2.0 * greatest(s / m, 0.0005) AS pt, -1.0 * greatest(s / m, 0.0005) AS sl FROM nb WHERE s IS NOT NULL),
pa AS (SELECT v.symbol, v.ts, v.pt, v.sl, b.n, b.ts AS at, b.close / c0 - 1 AS r FROM evs v JOIN nb b ON b.symbol = v.symbol AND b.n BETWEEN e AND e + 48),
ag AS (SELECT symbol, ts, pt, sl, min(n) FILTER (r >= pt) AS un, min(n) FILTER (r <= sl) AS dn, max(n) AS en, count(*) AS c FROM pa GROUP BY ALL),
hi AS (SELECT *, CASE WHEN un IS NOT NULL AND (dn IS NULL OR un <= dn) THEN un WHEN dn IS NOT NULL THEN dn ELSE en END AS hn, CASE WHEN un IS NOT NULL AND (dn IS NULL OR un <= dn) THEN 1.0::DOUBLE WHEN dn IS NOT NULL THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS bin FROM ag WHERE c >= 2),
lb AS MATERIALIZED (SELECT h.symbol, h.ts, p.at AS t1, p.r AS ret, bin, h.pt, h.sl FROM hi h JOIN pa p ON p.symbol = h.symbol AND p.ts = h.ts AND p.n = h.hn)"""


@query(f"{VWAP}, {_LABELS} SELECT symbol, ts, t1, {r(6, 'ret', 'pt', 'sl')}, bin FROM lb")
def q43_triple_barrier(spark: SparkSession, d: str) -> DataFrame:
    bars = vwap(spark, d)
    df = labels.triple_barrier(bars, _label_events(bars))
    return df.select("symbol", "ts", "t1", *(F.round(c, 6).alias(c) for c in ("ret", "pt", "sl")), "bin")


@query(f"{VWAP}, {_LABELS} SELECT symbol, CAST(bin = 1 AS INT) AS y, count(*) AS n FROM lb GROUP BY ALL")
def q44_meta_target(spark: SparkSession, d: str) -> DataFrame:
    bars = vwap(spark, d)
    df = labels.meta_target(labels.triple_barrier(bars, _label_events(bars)))
    return df.groupBy("symbol", "y").agg(F.count(F.lit(1)).alias("n"))


# --- signals, meta model, sizing -----------------------------------------------------------------


def _signal_inputs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(SIGNAL_INPUTS.replace("FROM bars", "FROM {bars}"), bars=daily(spark, d))


_P = PrimaryParams(range_pctb_lo=0.35, range_pctb_hi=0.65, range_rsi_lo=45.0, range_rsi_hi=55.0, range_confirm_reversal=True)
_SI = f"{BARS}, si AS MATERIALIZED ({SIGNAL_INPUTS})"
_TREND = f"""tr0 AS (SELECT *, coalesce((close - ema20) / nullif(atr_pct * close, 0), 0) AS away, tanh(donch_break_strength) AS st FROM si),
tr1 AS (SELECT *, is_trend_up > 0 AND trend_align >= 0.33 AND plus_di > minus_di AND adx >= 20 AND close >= ema50 AND away BETWEEN -1.2 AND 0.3 AND (macd_hist_slope > 0 OR rsi >= 40) AS lo,
  is_trend_dn > 0 AND trend_align <= -0.33 AND minus_di > plus_di AND adx >= 20 AND close <= ema50 AND away BETWEEN -0.3 AND 1.2 AND (macd_hist_slope < 0 OR rsi <= 60) AS sh FROM tr0),
tr2 AS (SELECT *, CASE WHEN sh THEN -greatest(least(0.55 + 0.2 * tanh(-macd_hist_z / 1.5) + 0.15 * greatest(-st, 0), 1), 0) WHEN lo THEN greatest(least(0.55 + 0.2 * tanh(macd_hist_z / 1.5) + 0.15 * greatest(st, 0), 1), 0) ELSE 0.0 END AS trend_score FROM tr1),
tr AS MATERIALIZED (SELECT *, CASE WHEN trend_score > 0.45 THEN 1 WHEN trend_score < -0.45 THEN -1 ELSE 0 END AS trend_side FROM tr2)"""
_RANGE = f"""ra0 AS (SELECT *, coalesce({lag('bb_pct_b')}, 0.5) AS b1, coalesce(rsi - {lag('rsi')}, 0) AS turn, is_range > 0 AND adx < 24 AND bb_width_pctl <= 0.55 AS calm FROM tr),
ra1 AS (SELECT *, calm AND bb_pct_b <= 0.35 AND b1 <= 0.35 + 0.05::DOUBLE AND bb_pct_b >= b1 - 0.02 AND rsi <= 45 AND bb_z < -1 AND (macd_hist_slope > 0 OR turn > 0) AS lo2,
  calm AND bb_pct_b >= 0.65 AND b1 >= 0.65 - 0.05::DOUBLE AND bb_pct_b <= b1 + 0.02 AND rsi >= 55 AND bb_z > 1 AND (macd_hist_slope < 0 OR turn < 0) AS sh2 FROM ra0),
ra2 AS (SELECT *, CASE WHEN sh2 THEN -least(0.55 + greatest(bb_pct_b - 0.65, 0) * 4, 1) WHEN lo2 THEN least(0.55 + greatest(0.35 - bb_pct_b, 0) * 4, 1) ELSE 0.0 END AS range_score FROM ra1),
ra AS MATERIALIZED (SELECT *, CASE WHEN range_score > 0.45 THEN 1 WHEN range_score < -0.45 THEN -1 ELSE 0 END AS range_side FROM ra2)"""


@query(f"{_SI}, {_TREND} SELECT symbol, ts, round(trend_score, 6) AS trend_score, trend_side FROM tr")
def q45_trend_signal(spark: SparkSession, d: str) -> DataFrame:
    return signals.trend_signal(_signal_inputs(spark, d), _P).select("symbol", "ts", F.round("trend_score", 6).alias("trend_score"), "trend_side")


@query(f"{_SI}, {_TREND}, {_RANGE} SELECT symbol, ts, round(range_score, 6) AS range_score, range_side FROM ra")
def q46_range_signal(spark: SparkSession, d: str) -> DataFrame:
    return signals.range_signal(_signal_inputs(spark, d), _P).select("symbol", "ts", F.round("range_score", 6).alias("range_score"), "range_side")


@query(f"""{_SI}, {_TREND}, {_RANGE},
p0 AS (SELECT symbol, ts, CASE WHEN is_chop > 0 THEN 0 WHEN trend_side <> 0 THEN trend_side ELSE range_side END AS side, CASE WHEN is_chop > 0 THEN 0 WHEN trend_side <> 0 THEN 1 WHEN range_side <> 0 THEN 2 ELSE 0 END AS mode,
  CASE WHEN is_chop > 0 THEN 0.0 WHEN trend_side = 0 AND range_side <> 0 THEN range_score ELSE trend_score END AS score FROM ra),
{numbered('p', 'side, mode, score', 'p0')},
cd AS (SELECT symbol, n, CASE WHEN side <> 0 THEN 5 ELSE 0 END AS rest, false AS skip FROM p WHERE n = 1
  UNION ALL SELECT p.symbol, p.n, CASE WHEN cd.rest > 0 THEN cd.rest - 1 WHEN p.side <> 0 THEN 5 ELSE 0 END, cd.rest > 0 FROM cd JOIN p ON p.symbol = cd.symbol AND p.n = cd.n + 1)
SELECT symbol, ts, CASE WHEN skip THEN 0 ELSE side END AS primary_side, CASE WHEN skip THEN 0 ELSE mode END AS primary_mode, round(CASE WHEN skip THEN 0.0 ELSE score END, 6) AS primary_score FROM cd JOIN p USING (symbol, n)""")
def q47_primary_signal_cooldown(spark: SparkSession, d: str) -> DataFrame:
    df = signals.primary_signals(_signal_inputs(spark, d), _P)
    return df.select("symbol", "ts", "primary_side", "primary_mode", F.round("primary_score", 6).alias("primary_score"))


_META = ["trend_align", "rsi", "bb_z", "bb_pct_b", "atr_pct", "macd_hist_z"]


#: The default of MetaParams, as are leaves and the rest.
TREES = 400


def _meta_rows(spark: SparkSession, d: str) -> DataFrame:
    bars = vwap(spark, d)
    y = labels.meta_target(labels.triple_barrier(bars, _label_events(bars))).select("symbol", "ts", "y")
    return _signal_inputs(spark, d).join(y, ["symbol", "ts"])


def _meta_fit(rows: DataFrame) -> meta.MetaModel:
    return meta.fit(rows, _META, MetaParams(n_estimators=TREES))


@query()
def q48_meta_fit_predict(spark: SparkSession, d: str) -> DataFrame:
    rows = _meta_rows(spark, d)
    return _meta_fit(rows).probabilities(rows).select("symbol", "ts", "y", "prob")


@query()
def q49_meta_filter_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = _meta_rows(spark, d)
    return _meta_fit(rows).filter_signals(rows.withColumn("side", F.when(F.col("trend_align") > 0, 1).otherwise(-1))).select("symbol", "ts", "side", "prob", "take")


#: Columns of lineitem with fewer values than a feature has bins, so that each value is an edge; the label is a return.
_TREE_FEATURES = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax", "month": "month(l_shipdate)"}


def _first_splits_sql() -> str:
    """Best splits of the root and of its two halves, from sums of gradients by value."""
    names = list(_TREE_FEATURES)
    columns = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _TREE_FEATURES.items())

    def level(name: str, source: str) -> str:
        values = " UNION ALL ".join(f"SELECT node, {i} AS f, {n} AS v, g, h FROM {source}" for i, n in enumerate(names))
        return f"""{name}0 AS (SELECT node, f, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({values}) GROUP BY ALL),
{name}1 AS (SELECT node, f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER p AS gt, sum(h) OVER p AS ht, sum(n) OVER p AS nt FROM {name}0
  WINDOW w AS (PARTITION BY node, f ORDER BY v), p AS (PARTITION BY node, f)),
{name}2 AS (SELECT *, gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht AS gain FROM {name}1 WHERE nl >= 20 AND nt - nl >= 20),
{name} AS (SELECT * FROM {name}2 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, v) = 1)"""

    split = " ".join(f"WHEN f = {i} THEN CAST({n} > v AS INT)" for i, n in enumerate(names))
    return f"""x AS (SELECT {columns}, CAST(l_returnflag = 'R' AS DOUBLE) AS y FROM lineitem), c AS (SELECT count(*) AS n, sum(y) AS n1 FROM x),
r AS (SELECT 0 AS node, x.*, CASE WHEN y = 1 THEN n / (2 * n1) ELSE n / (2 * (n - n1)) END * (0.5 - y) AS g, CASE WHEN y = 1 THEN n / (2 * n1) ELSE n / (2 * (n - n1)) END * 0.25 AS h FROM x, c),
{level('a', 'r')}, k AS (SELECT 1 + CASE {split} END AS node, r.* EXCLUDE (node) FROM r, a), {level('b', 'k')}
SELECT node, CASE f {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))} END AS feature, round(v, 4) AS threshold, round(gain, 4) AS gain, CAST(nt AS BIGINT) AS rows FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""


@query(_first_splits_sql())
def q85_first_tree_splits(spark: SparkSession, d: str) -> DataFrame:
    """Root and second level of a tree that tells returned items apart, over every line item."""
    columns = (F.expr(e).cast("double").alias(n) for n, e in _TREE_FEATURES.items())
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(*columns, (F.col("l_returnflag") == "R").cast("int").alias("y"))
    model = meta.fit(rows, list(_TREE_FEATURES), MetaParams(n_estimators=1, max_depth=2, colsample_bytree=1.0))
    nodes = spark.createDataFrame(model.trees.astype(object).where(model.trees.notna(), None), boosting.TREES)
    name = F.element_at(F.array(*map(F.lit, _TREE_FEATURES)), F.col("feature") + 1)
    return nodes.filter("feature IS NOT NULL").select("node", name.alias("feature"), F.round("threshold", 4).alias("threshold"), F.round("gain", 4).alias("gain"), "rows")


@query(f"""{VWAP}, k AS (SELECT symbol, ts, close AS price, 0.3 + 0.4 * (volume % 10) / 9.0 AS p, 0.5 + (volume % 7) / 3.0 AS b, (high - low) / close AS vol FROM bars),
f AS (SELECT *, least(greatest(0.25 * greatest(p - (1 - p) / b, 0), 0), 1) AS kelly, CASE WHEN vol > 0 THEN 10000 * least(0.15 / vol, 3) / price ELSE 0 END AS units FROM k)
SELECT symbol, ts, round(kelly, 8) AS kelly, round(units, 8) AS units, round(CASE WHEN p < 0.52 THEN 0 ELSE units * least(kelly / 0.25, 1) END, 8) AS size FROM f""")
def q57_kelly_vol_target_size(spark: SparkSession, d: str) -> DataFrame:
    df = vwap(spark, d).withColumns({"p": 0.3 + 0.4 * (F.col("volume") % 10) / 9.0, "b": 0.5 + (F.col("volume") % 7) / 3.0, "vol": (F.col("high") - F.col("low")) / F.col("close")})
    args = (F.lit(10_000.0), F.col("close"), F.col("vol"))
    return df.select(
        "symbol",
        "ts",
        F.round(signals.fractional_kelly(F.col("p"), F.col("b")), 8).alias("kelly"),
        F.round(signals.vol_target_size(*args), 8).alias("units"),
        F.round(signals.combined_size(*args, F.col("p"), F.col("b")), 8).alias("size"),
    )


# --- backtest and statistics ---------------------------------------------------------------------

_CFG = BacktestConfig(bars_per_year=252)


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Numbered bars and, on each that has a side by the 20-bar mean, that side, a mode (0, 1 or 2) and a
    scaled range as ATR."""
    bars = _sides(vwap(spark, d)).withColumn("n", W.row_no()).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    bars = stage(bars, "numbered")  # read by the plan, the paths, the ledger and the curve
    atr = F.greatest((F.col("high") - F.col("low")) / F.col("close") / 40, F.lit(1e-4))
    rows = bars.filter("primary_side <> 0 AND n < rows - 2")
    mode = F.col("n") % 3
    return bars, rows.select("symbol", F.col("n").alias("e"), F.col("primary_side").alias("side"), mode.cast("int").alias("mode"), atr.alias("atr_frac"))


_RT = _CFG.round_trip
_CAND = f"""{_SIDES}, nb AS MATERIALIZED (SELECT *, row_number() OVER {LAG} - 1 AS n, count(*) OVER (PARTITION BY symbol) AS cnt FROM sd),
ca AS (SELECT symbol, n AS e, close AS c0, side, CAST(n % 3 AS INT) AS mode, greatest((high - low) / close / 40, 1e-4) AS atr FROM nb WHERE side <> 0 AND n < cnt - 2),
cb AS (SELECT *, CASE mode WHEN 1 THEN 3.0 WHEN 2 THEN 1.5 ELSE 2.0 END * atr AS pt0, CASE mode WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE 1.0 END * atr AS sl0, CASE mode WHEN 1 THEN 72 WHEN 2 THEN 24 ELSE 48 END AS hold FROM ca),
cc AS (SELECT *, pt0 - {_RT!r} <= 0 OR (pt0 - {_RT!r}) / greatest(sl0 + {_RT!r}, 1e-9) < 1.3 AS poor, 1.3 * (sl0 + {_RT!r}) + {_RT!r} AS need FROM cb),
cd0 AS (SELECT *, CASE WHEN poor THEN need ELSE pt0 END AS pt1 FROM cc WHERE NOT poor OR need / atr <= 6),
pn AS MATERIALIZED (SELECT *, pt1 * CASE WHEN pt1 < 0.003 THEN 0.003 / greatest(pt1, 1e-9) ELSE 1 END AS pt, sl0 * CASE WHEN pt1 < 0.003 THEN 0.003 / greatest(pt1, 1e-9) ELSE 1 END AS sl FROM cd0)"""


@query(f"{VWAP}, {_CAND} SELECT symbol, e, mode, hold, round(pt, 8) AS pt_frac, round(sl, 8) AS sl_frac FROM pn")
def q54_cost_adjusted_rr_gate(spark: SparkSession, d: str) -> DataFrame:
    df = backtest.barrier_plan(_candidates(spark, d)[1].withColumn("e", F.col("e").cast("bigint")), _CFG)
    return df.select("symbol", "e", "mode", "hold", F.round("pt_frac", 8).alias("pt_frac"), F.round("sl_frac", 8).alias("sl_frac"))


_RESOLVE = f"""pp AS (SELECT p.*, b.n, p.side * (b.close / c0 - 1) AS r FROM pn p JOIN nb b ON b.symbol = p.symbol AND b.n BETWEEN e AND e + hold),
pk AS (SELECT *, greatest(max(r) OVER (PARTITION BY symbol, e ORDER BY n), 0) AS peak FROM pp),
ph AS (SELECT *, CASE WHEN n = e THEN NULL WHEN r >= pt THEN 1 WHEN r <= -sl THEN 2 WHEN mode = 1 AND peak > atr * 0.8 AND r <= peak - 2 * atr AND peak - 2 * atr > 0 THEN 3 END AS w FROM pk),
px AS (SELECT symbol, e, coalesce(min(n) FILTER (w IS NOT NULL), max(n)) AS x FROM ph GROUP BY ALL),
rs AS MATERIALIZED (SELECT h.symbol, h.e, h.side, h.mode, h.atr, h.pt, h.sl, x AS exit_n, CASE w WHEN 1 THEN pt WHEN 2 THEN -sl ELSE r END AS gross, CASE w WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END AS barrier
  FROM ph h JOIN px ON px.symbol = h.symbol AND px.e = h.e AND px.x = h.n)"""


def _resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bars, rows = _candidates(spark, d)
    return bars, backtest.resolve_barriers(backtest.barrier_plan(rows, _CFG), bars.select("symbol", "n", "close"), _CFG)


@query(f"{VWAP}, {_CAND}, {_RESOLVE} SELECT symbol, e, exit_n, barrier, round(gross, 8) AS gross_ret FROM rs")
def q55_barrier_resolution_trailing(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)[1].select("symbol", F.col("e").cast("bigint").alias("e"), F.col("exit_n").cast("bigint").alias("exit_n"), "barrier", F.round("gross_ret", 8).alias("gross_ret"))


_SINGLE = f"""{numbered('tq', 'e, exit_n', '(SELECT *, e AS ts FROM rs)')},
tk AS (SELECT symbol, n, true AS ok, exit_n AS free FROM tq WHERE n = 1 UNION ALL SELECT q.symbol, q.n, q.e > tk.free, CASE WHEN q.e > tk.free THEN q.exit_n ELSE tk.free END FROM tk JOIN tq q ON q.symbol = tk.symbol AND q.n = tk.n + 1),
td0 AS (SELECT r.* FROM tk JOIN tq q USING (symbol, n) JOIN rs r ON r.symbol = q.symbol AND r.e = q.e WHERE ok),
td1 AS (SELECT t.*, a.ts AS t0, b.ts AS t9, gross - {_RT!r} - date_diff('hour', a.ts, b.ts) / 8.0::DOUBLE * 0.0001 AS net, least(0.01 / greatest(sl, 1e-4), 3.0) AS size FROM td0 t JOIN nb a ON a.symbol = t.symbol AND a.n = e JOIN nb b ON b.symbol = t.symbol AND b.n = exit_n),
td AS MATERIALIZED (SELECT *, 10000 * exp(sum(ln(1 + size * net)) OVER (PARTITION BY symbol ORDER BY e)) AS eq FROM td1)"""


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bars, rows = _resolved(spark, d)
    numbered_bars = bars.select("symbol", "n", "ts", "close")
    return numbered_bars, backtest.trade_ledger(backtest.one_position(stage(rows, "resolved")), numbered_bars, _CFG)


@query(f"{VWAP}, {_CAND}, {_RESOLVE}, {_SINGLE} SELECT symbol, t0 AS entry_time, t9 AS exit_time, side, mode, barrier, round(net, 7) AS net_ret, round(size, 6) AS size_frac, round(eq, 2) AS equity_after FROM td")
def q58_single_position_trades(spark: SparkSession, d: str) -> DataFrame:
    df = _ledger(spark, d)[1]
    return df.select("symbol", "entry_time", "exit_time", "side", "mode", "barrier", F.round("net_ret", 7).alias("net_ret"), F.round("size_frac", 6).alias("size_frac"), F.round("equity_after", 2).alias("equity_after"))


_CURVE = f"""eq0 AS (SELECT nb.symbol, nb.ts, nb.n, t.eq FROM nb LEFT JOIN td t ON t.symbol = nb.symbol AND t.exit_n = nb.n),
eq1 AS (SELECT symbol, ts, coalesce(first_value(eq IGNORE NULLS) OVER {frame('1 FOLLOWING', 'UNBOUNDED FOLLOWING')}, last_value(eq IGNORE NULLS) OVER {PREFIX}, 10000) AS equity FROM eq0),
ec AS MATERIALIZED (SELECT symbol, ts, equity, coalesce(equity / {lag('equity')} - 1, 0) AS ret FROM eq1)"""


@query(f"{VWAP}, {_CAND}, {_RESOLVE}, {_SINGLE}, {_CURVE} SELECT symbol, ts, round(equity, 2) AS equity, round(ret, 7) AS ret FROM ec")
def q59_equity_curve(spark: SparkSession, d: str) -> DataFrame:
    bars, ledger = _ledger(spark, d)
    df = backtest.equity_curve(ledger, bars, _CFG)
    return df.select("symbol", "ts", F.round("equity", 2).alias("equity"), F.round("ret", 7).alias("ret"))


@query(f"""{VWAP}, {_CAND}, {_RESOLVE}, {_SINGLE}, {_CURVE}, g AS (SELECT *, exp(sum(ln(1 + ret)) OVER {PREFIX}) AS eq FROM ec), h AS (SELECT *, eq / max(eq) OVER {PREFIX} - 1 AS dd FROM g),
a AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS s, stddev_samp(ret) FILTER (ret < 0) AS dn, min(dd) AS dd, arg_max(eq, ts) AS fin, count(*) AS n FROM h GROUP BY symbol),
b AS (SELECT symbol, count(*) AS n_trades, avg(CAST(net > 0 AS INT)) AS win, sum(net) FILTER (net > 0) AS gain, -sum(net) FILTER (net < 0) AS loss, avg(net) AS mn FROM td GROUP BY symbol),
c AS (SELECT *, power(fin, 252.0 / n) - 1 AS cagr FROM a JOIN b USING (symbol))
SELECT symbol, n_trades, round(m / s * sqrt(252.0), 5) AS sharpe, round(m / dn * sqrt(252.0), 5) AS sortino, round(dd, 6) AS max_drawdown, round(cagr, 6) AS cagr, round(cagr / abs(nullif(dd, 0)), 5) AS calmar,
  round(win, 6) AS win_rate, round(coalesce(gain, 0) / nullif(loss, 0), 5) AS profit_factor, round(mn, 7) AS avg_trade_ret FROM c""")
def q50_performance_stats(spark: SparkSession, d: str) -> DataFrame:
    bars, ledger = _ledger(spark, d)
    df = backtest.performance(backtest.equity_curve(ledger, bars, _CFG), ledger, _CFG)
    places = {"sharpe": 5, "sortino": 5, "max_drawdown": 6, "cagr": 6, "calmar": 5, "win_rate": 6, "profit_factor": 5, "avg_trade_ret": 7}
    return df.select("symbol", "n_trades", *(F.round(c, n).alias(c) for c, n in places.items()))


@query(f"""{VWAP}, {_CAND}, {_RESOLVE}, {_SINGLE} SELECT symbol, mode, count(*) AS n, round(avg(CAST(net > 0 AS INT)), 6) AS win, round(avg(net), 7) AS mean_ret,
  round(coalesce(sum(net) FILTER (net > 0), 0) / nullif(-sum(net) FILTER (net < 0), 0), 5) AS profit_factor FROM td GROUP BY ALL""")
def q53_profit_factor_by_mode(spark: SparkSession, d: str) -> DataFrame:
    net = F.col("net_ret")
    losses = -F.sum(F.when(net < 0, net))
    return _ledger(spark, d)[1].groupBy("symbol", "mode").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((net > 0).cast("double")), 6).alias("win"),
        F.round(F.avg(net), 7).alias("mean_ret"),
        F.round(F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0.0)) / F.when(losses > 0, losses), 5).alias("profit_factor"),
    )


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return features.add_returns(vwap(spark, d)).select("symbol", "ts", F.col("log_ret").alias("ret"))


_TAIL = f"tl AS (SELECT * FROM (SELECT symbol, ts, log_ret AS ret, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM r WHERE log_ret IS NOT NULL) WHERE k <= 500)"


@query(f'{VWAP}, {_RET}, {_TAIL} SELECT symbol, count(*) AS "rows", round(-quantile_cont(ret, 0.05), 6) AS var FROM tl GROUP BY symbol')
def q51_historical_var(spark: SparkSession, d: str) -> DataFrame:
    return risk.value_at_risk(_returns(spark, d)).select("symbol", "rows", F.round("var", 6).alias("var"))


@query(f'{VWAP}, {_RET}, {_TAIL} SELECT x.symbol AS a, y.symbol AS b, count(*) AS "rows", round(corr(x.ret, y.ret), 6) AS corr FROM tl x JOIN tl y ON x.ts = y.ts AND x.symbol < y.symbol GROUP BY ALL')
def q52_correlation_cap(spark: SparkSession, d: str) -> DataFrame:
    return risk.correlations(_returns(spark, d)).select("a", "b", "rows", F.round("corr", 6).alias("corr"))


def _strategies(spark: SparkSession, d: str) -> DataFrame:
    """Returns of the classes of supplier keys as strategies: deterministic, one for each month and nation."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_shipdate", "l_extendedprice", "l_discount", "l_suppkey")
    t = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("bigint")
    return li.groupBy(t.alias("t"), (F.col("l_suppkey") % 6).cast("string").alias("strategy")).agg((F.round(F.avg(F.col("l_extendedprice") * (0.5 - 10 * F.col("l_discount"))), 2) / 100000).alias("ret"))


@query("""s AS MATERIALIZED (SELECT (year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS t, CAST(l_suppkey % 6 AS VARCHAR) AS strategy, round(avg(l_extendedprice * (0.5 - 10 * l_discount)), 2) / 100000 AS ret FROM lineitem GROUP BY ALL),
w AS (SELECT (max(t) + 1) // 8 AS w FROM s), b AS MATERIALIZED (SELECT strategy, t // w AS b, count(ret) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM s, w WHERE t < w * 8 GROUP BY ALL),
c AS (SELECT m FROM range(256) x(m) WHERE bit_count(m) = 4),
p AS (SELECT m, strategy, sum(n) FILTER ((m >> b) & 1 = 1) AS n0, sum(s) FILTER ((m >> b) & 1 = 1) AS s0, sum(q) FILTER ((m >> b) & 1 = 1) AS q0, sum(n) FILTER ((m >> b) & 1 = 0) AS n1, sum(s) FILTER ((m >> b) & 1 = 0) AS s1, sum(q) FILTER ((m >> b) & 1 = 0) AS q1 FROM b, c GROUP BY ALL),
z AS (SELECT m, strategy, s0 / n0 / (sqrt((q0 - s0 * s0 / n0) / (n0 - 1)) + 1e-9) AS tr, s1 / n1 / (sqrt((q1 - s1 * s1 / n1) / (n1 - 1)) + 1e-9) AS te FROM p),
y AS (SELECT *, first_value(te) OVER (PARTITION BY m ORDER BY tr DESC, strategy) AS best FROM z),
k AS (SELECT m, sum(CAST(te <= best AS INT)) / count(*) AS rk FROM y GROUP BY m) SELECT round(avg(CAST(rk <= 0.5 AS INT)), 6) AS pbo, count(*) AS n_combinations FROM k""")
def q56_pbo_cscv(spark: SparkSession, d: str) -> DataFrame:
    return validation.overfitting_probability(_strategies(spark, d)).select(F.round("pbo", 6).alias("pbo"), "n_combinations")


# --- joins ---------------------------------------------------------------------------------------


@query(f"{BARS}, {_RET} SELECT x.symbol, y.symbol AS other, x.ts, round(x.log_ret, 8) AS ret, round(y.log_ret, 8) AS other_ret FROM r x JOIN r y ON x.ts = y.ts AND x.symbol < y.symbol")
def q60_aligned_returns_join(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of symbols."""
    df = features.add_returns(daily(spark, d)).select("symbol", "ts", F.round("log_ret", 8).alias("ret"))
    others = df.select(F.col("symbol").alias("other"), "ts", F.col("ret").alias("other_ret"))
    return df.join(others, "ts").filter("symbol < other").select("symbol", "other", "ts", "ret", "other_ret")


@query(f"""{BARS}, o AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY ALL)
SELECT symbol, ts, coalesce(price, 0.0) AS price FROM bars LEFT JOIN o USING (ts)""")
def q61_reindex_left_join(spark: SparkSession, d: str) -> DataFrame:
    day = F.window(F.col("o_orderdate").cast("timestamp_ntz"), "1 day")["start"].alias("ts")
    orders = spark.read.parquet(f"{d}/orders.parquet").groupBy(day).agg(F.round(F.sum("o_totalprice"), 2).alias("price"))
    return daily(spark, d).select("symbol", "ts").join(orders, "ts", "left").select("symbol", "ts", F.coalesce("price", F.lit(0.0)).alias("price"))


@query(f"{VWAP}, {_CUSUM}, {_SIDES} SELECT symbol, ts, side, 1 AS mode FROM sd SEMI JOIN ev USING (symbol, ts) WHERE side <> 0")
def q62_event_semi_join(spark: SparkSession, d: str) -> DataFrame:
    bars = vwap(spark, d)
    sides = _sides(bars).select("symbol", "ts", F.col("primary_side").alias("side"), F.lit(1).alias("mode"))
    return backtest.gate_events(labels.cusum_events(bars), bars, sides, _CFG).select("symbol", "ts", "side", "mode")


@query(f"""{BARS}, a AS (SELECT symbol, ts, row_number() OVER {LAG} - 1 AS row_no, count(*) OVER (PARTITION BY symbol) AS n, lead(ts, 10) OVER {LAG} AS ee FROM bars),
f AS (SELECT DISTINCT symbol, k, k * (n // 6) AS s, CASE WHEN k = 5 THEN n ELSE (k + 1) * (n // 6) END AS e, greatest(CAST(ceil(n * 0.01::DOUBLE) AS BIGINT), 1) AS g, n FROM a, range(6) x(k)),
b AS MATERIALIZED (SELECT f.*, p.ts AS t0, q.ts AS t9 FROM f JOIN a p ON p.symbol = f.symbol AND p.row_no = s JOIN a q ON q.symbol = f.symbol AND q.row_no = e - 1),
st AS MATERIALIZED (SELECT a.symbol, a.row_no, k, row_no >= s AND row_no < e AS t, coalesce(ee >= t0 AND ts <= t9, false) OR (row_no >= e AND row_no < least(e + g, a.n)) AS o FROM a JOIN b ON a.symbol = b.symbol),
c AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS combo_id FROM range(6) x(i), range(6) y(j) WHERE i < j),
z AS (SELECT c.combo_id, x.symbol, x.row_no, x.t OR y.t AS t, x.o OR y.o AS o FROM c JOIN st x ON x.k = i JOIN st y ON y.k = j AND y.symbol = x.symbol AND y.row_no = x.row_no)
SELECT symbol, combo_id, CASE WHEN t THEN 'test' ELSE 'train' END AS role, count(*) AS n, CAST(sum(row_no) AS BIGINT) AS row_sum FROM z WHERE t OR NOT o GROUP BY ALL""")
def q63_purged_folds_cpcv(spark: SparkSession, d: str) -> DataFrame:
    bars = daily(spark, d).select("symbol", "ts", W.row_no().cast("bigint").alias("row_no"), F.lead("ts", 10).over(W.by_time()).alias("event_end"))
    roles = validation.cpcv_roles(bars)
    return roles.groupBy("symbol", F.col("combo_id").cast("bigint").alias("combo_id"), "role").agg(F.count(F.lit(1)).alias("n"), F.sum("row_no").alias("row_sum"))


@query(f"{BARS}, {PIVOTS}, pl AS (SELECT symbol, ts, price, kind FROM piv), {_AT} SELECT symbol, ts, price, kind FROM ao")
def q64_asof_latest_pivot(spark: SparkSession, d: str) -> DataFrame:
    bars = daily(spark, d)
    last = F.col("__p")[0]
    return features.as_of_pivots(bars, _extremes(bars), 1).select("symbol", "ts", last["price"].alias("price"), last["kind"].alias("kind"))


@query(f"""{EVENT_BARS}, a AS (SELECT b.symbol, b.ts, b.close / p.close - 1 AS x FROM bars b ASOF LEFT JOIN bars p ON b.symbol = p.symbol AND b.ts - INTERVAL 1 DAY > p.ts),
{numbered('s', 'x', "(SELECT * FROM a WHERE x IS NOT NULL)")}, k AS (SELECT 1 - 2.0::DOUBLE / 101 AS d),
e AS (SELECT symbol, n, CAST(1.0 AS DOUBLE) AS sw, CAST(1.0 AS DOUBLE) AS sw2, x AS m, CAST(0.0 AS DOUBLE) AS c FROM s WHERE n = 1
  UNION ALL SELECT s.symbol, s.n, e.sw * d + 1, e.sw2 * d * d + 1, (e.sw * d * e.m + s.x) / (e.sw * d + 1), e.c * d + e.sw * d / (e.sw * d + 1) * (s.x - e.m) * (s.x - e.m) FROM e JOIN s ON s.symbol = e.symbol AND s.n = e.n + 1, k)
SELECT b.symbol, b.ts, CASE WHEN v.n >= 20 THEN round(sqrt(c / sw * sw * sw / (sw * sw - sw2)), 6) END AS target_vol FROM bars b LEFT JOIN (SELECT * FROM e JOIN s USING (symbol, n)) v USING (symbol, ts)""")
def q65_daily_vol_asof_1d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labels.daily_volatility(hourly(spark, d)), 6, "target_vol")


# --- the same by machines that stream a symbol's rows ------------------------------------------------


@as_in("q28_zigzag")
def q28_zigzag_streamed(spark: SparkSession, d: str) -> DataFrame:
    return features.zigzag_pivots(features.add_atr(hourly(spark, d)), 1.0, streamed=True)


@as_in("q42_cusum_events")
def q42_cusum_events_streamed(spark: SparkSession, d: str) -> DataFrame:
    return labels.cusum_events(vwap(spark, d), streamed=True)


@as_in("q58_single_position_trades")
def q58_single_position_streamed(spark: SparkSession, d: str) -> DataFrame:
    bars, rows = _resolved(spark, d)
    df = backtest.trade_ledger(backtest.one_position(rows, streamed=True), bars.select("symbol", "n", "ts", "close"), _CFG)
    return df.select("symbol", "entry_time", "exit_time", "side", "mode", "barrier", F.round("net_ret", 7).alias("net_ret"), F.round("size_frac", 6).alias("size_frac"), F.round("equity_after", 2).alias("equity_after"))


# --- the same by blocks of time: no task holds a symbol --------------------------------------------

#: Bars of a block in these queries; far fewer than the default, so that series have many blocks.
BLOCK_BARS = 100


@as_in("q14_ema")
def q14_ema_blocks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(long_series.add_emas(Blocks.of(daily(spark, d), BLOCK_BARS), (20,)).bars(), 4, "ema20")


@as_in("q15_atr_wilder")
def q15_atr_wilder_blocks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(long_series.add_atr(Blocks.of(daily(spark, d), BLOCK_BARS)).bars(), 4, "atr_14")


@as_in("q17_adx")
def q17_adx_blocks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(long_series.add_adx(Blocks.of(daily(spark, d), BLOCK_BARS)).bars(), 5, "adx", "plus_di", "minus_di", "di_spread")


@as_in("q24_hawkes")
def q24_hawkes_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = Blocks.of(daily(spark, d), BLOCK_BARS).windows(1, lambda df: df.withColumn("c1", features.lag("close")))
    return rounded(long_series.add_hawkes(b, 0.1, events=W.flag(F.col("close") > 1.5 * F.col("c1"))).bars(), 6, "hawkes_intensity")


@as_in("q32_vol_quantile_regime")
def q32_vol_quantile_regime_blocks(spark: SparkSession, d: str) -> DataFrame:
    return long_series.add_vol_regime(Blocks.of(daily(spark, d), BLOCK_BARS)).select("symbol", "ts", "regime")


@as_in("q65_daily_vol_asof_1d")
def q65_daily_vol_blocks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(long_series.daily_volatility(hourly(spark, d), rows=BLOCK_BARS), 6, "target_vol")



@query(f"{VWAP}, {_CUSUM}, a AS (SELECT symbol, ts, coalesce(lead(ts, 48) OVER {LAG}, last_value(ts) OVER {frame('UNBOUNDED PRECEDING', 'UNBOUNDED FOLLOWING')}) AS t1 FROM bars) SELECT symbol, ts, t1 FROM a SEMI JOIN ev USING (symbol, ts)")
def q66_vertical_barrier(spark: SparkSession, d: str) -> DataFrame:
    bars = vwap(spark, d)
    return labels.vertical_barriers(bars, labels.cusum_events(bars))


@query(f"{BARS}, a AS (SELECT symbol, close, row_number() OVER {LAG} - 1 AS n FROM bars) SELECT x.symbol, x.n AS e, count(*) AS len, round(max(y.close), 4) AS top FROM a x JOIN a y ON y.symbol = x.symbol AND y.n BETWEEN x.n AND x.n + 24 GROUP BY ALL")
def q67_band_join_paths(spark: SparkSession, d: str) -> DataFrame:
    bars = daily(spark, d).select("symbol", "close", W.row_no().alias("n"))
    paths = labels.band_join(bars.select("symbol", F.col("n").alias("e")), bars, 24)
    return paths.groupBy("symbol", F.col("e").cast("bigint").alias("e")).agg(F.count(F.lit(1)).alias("len"), F.round(F.max("close"), 4).alias("top"))


# --- reports, search, risk -----------------------------------------------------------------------


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Order figures in the shape of backtest cells."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    price, tf = F.col("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, 5).otherwise(60)
    return o.select(
        F.col("o_orderpriority").alias("profile"), tf.alias("tf_min"), (F.col("o_orderkey") % 50).alias("n_trades"), (price / 100000 - 1).alias("sharpe"), (price / 150000).alias("profit_factor"),
        (F.col("o_orderkey") % 100 / 100.0).alias("win_rate"), (-(F.col("o_custkey") % 50) / 100.0).alias("max_dd"), (price / 5000 - 30).alias("equity_pct"),
    )


_CELLS = """ce AS (SELECT o_orderpriority AS profile, CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 60 END AS tf_min, o_orderkey % 50 AS n_trades, o_totalprice / 100000 - 1 AS sharpe, o_totalprice / 150000 AS profit_factor,
  (o_orderkey % 100) / 100.0::DOUBLE AS win_rate, -(o_custkey % 50) / 100.0::DOUBLE AS max_dd, o_totalprice / 5000 - 30 AS equity_pct FROM orders)"""
_MEANS = "round(avg(n_trades), 3) AS n_trades, round(avg(sharpe), 3) AS sharpe, round(avg(profit_factor), 3) AS pf, round(avg(win_rate), 3) AS win, round(avg(max_dd), 3) AS mdd, round(avg(equity_pct), 3) AS eq_pct"


@query(f"{_CELLS}, g AS (SELECT profile, tf_min, {_MEANS} FROM ce GROUP BY ALL) SELECT *, CASE WHEN sharpe >= 0.8 AND pf >= 1.2 AND mdd >= -0.2 THEN 'live-ready' WHEN eq_pct < -10 THEN 'avoid' ELSE 'none' END AS flag FROM g")
def q70_grid_group_means(spark: SparkSession, d: str) -> DataFrame:
    return research.viability(_cells(spark, d))


@query(f"{_CELLS} SELECT CAST(grouping_id(profile, tf_min) AS INT) AS level, coalesce(profile, 'all') AS profile, coalesce(CAST(tf_min AS VARCHAR), 'all') AS tf_min, count(*) AS cells, {_MEANS} FROM ce GROUP BY ROLLUP (profile, tf_min)")
def q86_rollup_report(spark: SparkSession, d: str) -> DataFrame:
    every = {c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("profile", "tf_min")}
    return research.rollup_report(_cells(spark, d)).withColumns(every)


@query(f"""{_CELLS} SELECT count(*) AS cells, CAST(sum(n_trades) AS BIGINT) AS trades, CAST(count_if(equity_pct > 0) AS BIGINT) AS profitable, CAST(count_if(profit_factor > 1.2) AS BIGINT) AS pf_ok, CAST(count_if(sharpe > 0.8) AS BIGINT) AS sharpe_ok,
  CAST(count_if(max_dd > -0.3) AS BIGINT) AS mdd_ok, round(avg(sharpe), 6) AS mean_sharpe, round(median(sharpe), 6) AS median_sharpe FROM ce""")
def q71_health_counts(spark: SparkSession, d: str) -> DataFrame:
    return research.health(_cells(spark, d))


def _normal_cdf(x: str) -> str:
    """SQL for the normal distribution by its power series; beyond 8 deviations 0 or 1."""
    term = f"exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2)"
    return f"CASE WHEN abs({x}) > 8 THEN CAST({x} > 0 AS INT) ELSE 0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * (SELECT sum({term}) FROM range(200) t(k)) END"


#: Trials of a search and the variance of their ratios.
_TRIALS, _VARIANCE = 20, 0.01


@query(f"""{VWAP}, {_RET}, m AS (SELECT symbol, avg(log_ret) AS mean, stddev_samp(log_ret) AS sd, count(log_ret) AS n FROM r GROUP BY symbol),
c AS (SELECT r.symbol, avg(power(log_ret - mean, 2)) AS m2, avg(power(log_ret - mean, 3)) AS m3, avg(power(log_ret - mean, 4)) AS m4 FROM r JOIN m USING (symbol) WHERE log_ret IS NOT NULL GROUP BY r.symbol),
d AS (SELECT symbol, n, mean / sd AS sr, m3 / power(m2, 1.5) AS skew, m4 / (m2 * m2) AS kurt FROM m JOIN c USING (symbol)),
z AS (SELECT symbol, sr, sr * sqrt(n - 1) / s AS z0, (sr - {validation.expected_best(_TRIALS, _VARIANCE)!r}) * sqrt(n - 1) / s AS z1 FROM (SELECT *, sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-9)) AS s FROM d))
SELECT symbol, round(sr, 10) AS sr, round({_normal_cdf('z0')}, 10) AS psr, round({_normal_cdf('z1')}, 10) AS dsr FROM z""")
def q72_psr_dsr(spark: SparkSession, d: str) -> DataFrame:
    found = validation.sharpe_probabilities(_returns(spark, d), _TRIALS, _VARIANCE)
    return found.select("symbol", *(F.round(c, 10).alias(c) for c in ("sr", "psr", "dsr")))


@query(f"""{VWAP}, {_CAND}, {_RESOLVE}, {_SINGLE}, tn AS MATERIALIZED (SELECT row_number() OVER (ORDER BY symbol, e) - 1 AS i, net FROM td), nn AS (SELECT count(*) AS n FROM tn),
dp AS (SELECT sim, n, unnest(range(n)) AS pos FROM range(2000) x(sim), nn),
dr AS (SELECT sim, pos, CAST('0x' || substr(md5('42-' || sim || '-' || pos), 1, 8) AS BIGINT) % n AS i FROM dp),
gr AS (SELECT sim, pos, exp(sum(ln(abs(1 + net))) OVER w) * CASE WHEN sum(CAST(net < -1 AS INT)) OVER w % 2 = 1 THEN -1 ELSE 1 END AS g
  FROM dr JOIN tn USING (i) WINDOW w AS (PARTITION BY sim ORDER BY pos ROWS UNBOUNDED PRECEDING)),
gd AS (SELECT *, g / max(g) OVER (PARTITION BY sim ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM gr), fi AS (SELECT sim, arg_max(g, pos) - 1 AS final, min(dd) AS dd FROM gd GROUP BY sim)
SELECT {r(6, 'mean_ret=avg(final)', 'median_ret=quantile_cont(final, 0.5)', 'p5_ret=quantile_cont(final, 0.05)', 'p95_ret=quantile_cont(final, 0.95)', 'p5_dd=quantile_cont(dd, 0.05)', 'mean_dd=avg(dd)')} FROM fi""")
def q73_mc_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    df = validation.bootstrap(_ledger(spark, d)[1].select("symbol", "e", "net_ret"))
    return df.select(*(F.round(c, 6).alias(c) for c in df.columns))


#: Eight trials take about a minute on eight cores, most of it planning, so that the query makes fewer than the
#: 200 of a real search; its gates and tables are the real ones.
SEARCH_TRIALS = 8


@query()
def q74_parameter_search(spark: SparkSession, d: str) -> DataFrame:
    bars = B.with_vwap_close(B.time_bars(B.lineitem_ticks(spark, d, "ALL"), "1 day"))
    return research.search(spark, stage(bars, "search"), SEARCH_TRIALS)


#: A space of two real and one whole parameter, and the points whose densities are asked for.
_TPE_SPACE = (tpe.Range("x", 0.0, 97.0), tpe.Range("y", -1.0, 32.0), tpe.Range("k", 0, 14))
_TPE_POINTS = [{"x": (i * 61 % 97) + 0.25, "y": (i * 19 % 33) - 0.5, "k": i * 7 % 15} for i in range(tpe.CANDIDATES)]


def _tpe_sql() -> str:
    bell = lambda d: f"exp(-power({d}, 2) / (2 * h * h))"
    kernel = " * ".join(f"(({bell(f'c.{v} - o.{v}')} + {bell(f'c.{v} + o.{v}')} + {bell(f'2 - c.{v} - o.{v}')}) / (h * sqrt(2 * pi())))" for v in "xyk")
    points = ", ".join(f"({i}, {p['x']}, {p['y']}, {p['k']})" for i, p in enumerate(_TPE_POINTS))
    unit = lambda t: f"{t}.x / 97.0 AS x, ({t}.y + 1) / 33.0 AS y, ({t}.k + 0.5) / 15.0 AS k"
    return f"""t AS (SELECT o_orderkey AS trial, o_totalprice AS value, CAST(o_custkey % 97 AS DOUBLE) AS x, CAST(day(o_orderdate) AS DOUBLE) AS y, CAST(o_orderkey % 15 AS DOUBLE) AS k FROM orders),
n AS (SELECT count(*) AS n, max(trial) AS newest, least(ceil(0.1 * count(*)), 25) AS best FROM t),
g AS (SELECT trial FROM t ORDER BY value DESC, trial LIMIT (SELECT best FROM n)),
o AS (SELECT {unit('t')}, trial IN (SELECT trial FROM g) AS good, CASE WHEN trial IN (SELECT trial FROM g) THEN 1.0 ELSE least(1.0, (trial + 1) / CAST(greatest(1, newest + 1 - 25) AS DOUBLE)) END AS w,
  CASE WHEN trial IN (SELECT trial FROM g) THEN best ELSE n - best END AS m FROM t, n),
u AS (SELECT *, greatest(0.2 * power(m, -1.0 / 7), 1.0 / least(100, m + 1)) AS h FROM o),
p(candidate, x, y, k) AS (VALUES {points}), c AS (SELECT candidate, {unit('p')} FROM p),
s AS (SELECT candidate, good, ln((1 + sum(w * {kernel})) / (1 + sum(w))) AS l FROM c, u o GROUP BY ALL)
SELECT a.candidate, round(a.l, 6) AS log_good, round(b.l, 6) AS log_rest, round(a.l - b.l, 6) AS score FROM s a JOIN s b USING (candidate) WHERE a.good AND NOT b.good"""


@query(_tpe_sql())
def q84_parzen_densities(spark: SparkSession, d: str) -> DataFrame:
    """What a search would try next if every order were a trial, with its price as the value."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    point = {"x": F.col("o_custkey") % 97, "y": F.day("o_orderdate"), "k": F.col("o_orderkey") % 15}
    trials = orders.select(F.col("o_orderkey").alias("trial"), F.col("o_totalprice").alias("value"), *(c.cast("double").alias(n) for n, c in point.items()))
    found = tpe.densities(trials, _TPE_SPACE, _TPE_POINTS)
    return found.select("candidate", *(F.round(c, 6).alias(c) for c in ("log_good", "log_rest", "score")))


@query(f"{_CELLS}, t AS (SELECT o_orderkey AS trial, round(o_totalprice, 2) AS value FROM orders) SELECT trial, value FROM t ORDER BY value DESC, trial LIMIT 20")
def q77_top_k_trials(spark: SparkSession, d: str) -> DataFrame:
    trials = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("trial"), F.round("o_totalprice", 2).alias("value"))
    return research.best_trials(trials, 200)


_EQ = f"eq AS (SELECT symbol, ts, round(close, 4) AS equity FROM bars), a AS (SELECT *, equity - coalesce({lag('equity')}, equity) AS pnl, max(equity) OVER {PREFIX} AS peak FROM eq)"


@query(f"""{EVENT_BARS}, {_EQ}, b AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / greatest(peak, 1e-9) AS dr, equity / peak - 1 AS dd FROM a),
c AS (SELECT *, CAST(dr <= -5.0 OR dd <= -0.9999 AS INT) AS st, CAST(dr <= -5.0 * 0.6 OR dd <= -0.9999 * 0.66 AS INT) AS so FROM b),
e AS (SELECT *, sum(st) OVER {PREFIX} > 0 AS halted, max(so) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 0 AS half FROM c)
SELECT symbol, ts, round(dr, 6) AS daily_return, round(dd, 6) AS drawdown, halted, CASE WHEN halted THEN 0.0::DOUBLE WHEN half THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS size_multiplier FROM e""")
def q75_risk_breakers(spark: SparkSession, d: str) -> DataFrame:
    equity = hourly(spark, d).select("symbol", "ts", F.round("close", 4).alias("equity"))
    df = risk.breakers(equity, RiskLimits(daily_loss_limit=5.0, max_drawdown=0.9999))
    return df.select("symbol", "ts", F.round("daily_return", 6).alias("daily_return"), F.round("drawdown", 6).alias("drawdown"), "halted", "size_multiplier")


@query(f"""{BARS}, {_RET}, x AS (SELECT symbol, ts, round(log_ret, 4) AS x FROM r WHERE log_ret IS NOT NULL), rf AS (SELECT * FROM x WHERE ts < TIMESTAMP '1996-01-01'),
lv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM x WHERE ts >= TIMESTAMP '1996-01-01') WHERE k <= 500),
u AS (SELECT symbol, x, sum(a) AS a, sum(b) AS b FROM (SELECT symbol, x, 1 AS a, 0 AS b FROM rf UNION ALL SELECT symbol, x, 0, 1 FROM lv) GROUP BY ALL),
g AS (SELECT symbol, max(abs(d)) AS ks FROM (SELECT symbol, CAST(sum(a) OVER (PARTITION BY symbol ORDER BY x) AS DOUBLE) / sum(a) OVER (PARTITION BY symbol) - CAST(sum(b) OVER (PARTITION BY symbol ORDER BY x) AS DOUBLE) / sum(b) OVER (PARTITION BY symbol) AS d FROM u) GROUP BY symbol),
m AS (SELECT symbol, avg(x) AS rm, stddev_pop(x) + 1e-9 AS rs, count(*) AS m FROM rf GROUP BY symbol), l AS (SELECT symbol, avg(x) AS lm, count(*) AS n FROM lv GROUP BY symbol),
f AS (SELECT symbol, n, m, ks, (lm - rm) / rs * sqrt(n) AS z FROM g JOIN m USING (symbol) JOIN l USING (symbol)),
v AS (SELECT symbol, n::BIGINT AS n, m::BIGINT AS m, round(ks * n * m)::BIGINT AS reach FROM f),
w AS (SELECT symbol, 0::BIGINT AS s, [CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR i IN range(n + 1)] AS p FROM v
  UNION ALL SELECT symbol, s + 1, list_transform(range(n + 1), lambda i: CASE WHEN s + 1 - i BETWEEN 0 AND m AND abs(i * m - (s + 1 - i) * n) < reach
    THEN (coalesce(p[i], 0) * (n - i + 1) + p[i + 1] * (m - s + i)) / (n + m - s) ELSE 0.0::DOUBLE END) FROM w JOIN v USING (symbol) WHERE s < n + m),
p AS (SELECT f.*, 1 - w.p[v.n + 1] AS p FROM f JOIN v USING (symbol) JOIN w ON w.symbol = v.symbol AND w.s = v.n + v.m)
SELECT symbol, n AS "rows", round(ks, 6) AS ks, round(p, 6) AS ks_p, round(z, 6) AS z, coalesce(n >= 50 AND (p < 0.01 OR abs(z) > 3), false) AS drift FROM p""")
def q76_drift_ks_z(spark: SparkSession, d: str) -> DataFrame:
    values = features.add_returns(daily(spark, d)).select("symbol", "ts", F.round("log_ret", 4).alias("x"))
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    df = risk.drift(values.filter(F.col("ts") < cut), values.filter(F.col("ts") >= cut), DriftConfig())
    return df.select("symbol", "rows", *(F.round(c, 6).alias(c) for c in ("ks", "ks_p", "z")), "drift")


@query(f"{VWAP}, {_RET} SELECT symbol, round(CASE WHEN stddev_samp(log_ret) > 0 THEN avg(log_ret) / stddev_samp(log_ret) * sqrt(252.0) ELSE 0 END, 6) AS sharpe FROM r GROUP BY symbol")
def q78_sharpe_ratio(spark: SparkSession, d: str) -> DataFrame:
    return validation.sharpe(_returns(spark, d), 252).select("symbol", F.round("sharpe", 6).alias("sharpe"))


@query(f"""{BARS}, a AS (SELECT symbol, ts, row_number() OVER {LAG} - 1 AS row_no, count(*) OVER (PARTITION BY symbol) AS n, lead(ts, 10) OVER {LAG} AS ee FROM bars),
f AS (SELECT DISTINCT symbol, k, k * (n // 5) AS s, CASE WHEN k = 4 THEN n ELSE (k + 1) * (n // 5) END AS e, greatest(CAST(ceil(n * 0.01::DOUBLE) AS BIGINT), 1) AS g, n FROM a, range(5) x(k)),
b AS MATERIALIZED (SELECT f.*, p.ts AS t0, q.ts AS t9 FROM f JOIN a p ON p.symbol = f.symbol AND p.row_no = s JOIN a q ON q.symbol = f.symbol AND q.row_no = e - 1),
z AS (SELECT a.symbol, a.row_no, k, row_no >= s AND row_no < e AS t, coalesce(ee >= t0 AND ts <= t9, false) OR (row_no >= e AND row_no < least(e + g, a.n)) AS o FROM a JOIN b ON a.symbol = b.symbol)
SELECT symbol, k AS fold, CASE WHEN t THEN 'test' ELSE 'train' END AS role, count(*) AS n, CAST(sum(row_no) AS BIGINT) AS row_sum FROM z WHERE t OR NOT o GROUP BY ALL""")
def q79_purged_kfold(spark: SparkSession, d: str) -> DataFrame:
    bars = daily(spark, d).select("symbol", "ts", W.row_no().cast("bigint").alias("row_no"), F.lead("ts", 10).over(W.by_time()).alias("event_end"))
    roles = validation.purged_kfold_roles(bars)
    return roles.groupBy("symbol", F.col("combo_id").cast("bigint").alias("fold"), "role").agg(F.count(F.lit(1)).alias("n"), F.sum("row_no").alias("row_sum"))


@query(f"{BARS}, {numbered('s', f'coalesce(abs(ln(close) - {lag("ln(close)")}), 0.0) AS x')}, {ewm('e', 's', {'y': ('x', 2 / 15)})} SELECT symbol, ts, round(y, 8) AS atr_frac FROM e JOIN s USING (symbol, n)")
def q80_default_atr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.default_atr(daily(spark, d)), 8, "atr_frac")


#: Returns of lineitem are hardly correlated, so that a small cap lets some positions meet it.
_CAP = RiskLimits(correlation_cap=0.02)


@query(f"""{VWAP}, {_RET}, {_TAIL}, w AS (SELECT symbol, unnest([1, -1]) AS side FROM (SELECT DISTINCT symbol FROM bars)),
c AS (SELECT x.symbol, count(*) AS n, corr(x.ret, y.ret) AS c FROM tl x JOIN tl y ON x.ts = y.ts AND y.symbol = 'A' AND x.symbol <> 'A' GROUP BY ALL),
v AS (SELECT symbol, count(*) AS n, -quantile_cont(ret, 0.05) AS var FROM tl GROUP BY symbol),
o AS (SELECT w.*, CASE WHEN symbol = 'A' THEN 'position already open' WHEN side = 1 AND c.n >= 50 AND abs(c) >= 0.02 THEN 'correlation cap vs A'
  WHEN v.n >= 100 AND var > 0.05 THEN 'value at risk' ELSE 'ok' END AS reason FROM w LEFT JOIN c USING (symbol) LEFT JOIN v USING (symbol))
SELECT symbol, side, reason = 'ok' AS ok, reason FROM o""")
def q81_open_gate(spark: SparkSession, d: str) -> DataFrame:
    """All symbols, both sides, with a long position in one of them."""
    returns = _returns(spark, d)
    wanted = returns.select("symbol").distinct().select("symbol", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"))
    held = spark.createDataFrame([("A", 1)], "symbol string, side int")
    return risk.open_reasons(wanted, held, returns, limits=_CAP)


@query(f"{VWAP}, {_CAND}, {_RESOLVE}, {_SINGLE} SELECT symbol, t0 AS entry_time, t9 AS exit_time, side, mode, barrier, round(net, 7) AS net_ret FROM td ORDER BY t9 DESC, symbol, e LIMIT 500")
def q82_last_trades(spark: SparkSession, d: str) -> DataFrame:
    df = research.last_trades(_ledger(spark, d)[1])
    return df.select("symbol", "entry_time", "exit_time", "side", "mode", "barrier", F.round("net_ret", 7).alias("net_ret"))


@query(f"{BARS} SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close, arg_max(volume, ts) AS volume FROM bars GROUP BY symbol")
def q83_last_row(spark: SparkSession, d: str) -> DataFrame:
    return research.last_rows(daily(spark, d)).select("symbol", "ts", "close", "volume")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars, 20-bar volatility targets, triple-barrier labels: counts and mean returns by label."""
    df = labels.triple_barrier(vwap(spark, d), _label_events(vwap(spark, d)))
    return df.groupBy("symbol", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ret"), 6).alias("mean_ret"))


