"""Building blocks of the DuckDB oracle queries."""

from __future__ import annotations

_TIE = "{'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': l_suppkey, 'f': l_extendedprice}"


def bars(symbol: str = "l_returnflag", close: str = "arg_max(price, k)", name: str = "bars") -> str:
    """Daily bars of lineitem as a CTE."""
    return f"""{name} AS MATERIALIZED (
  SELECT symbol, date_trunc('day', ts) AS ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, {close} AS close,
         sum(volume) AS volume, round(sum(turnover), 2) AS turnover
  FROM (SELECT {symbol} AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts, l_extendedprice / l_quantity AS price, CAST(l_quantity AS DOUBLE) AS volume,
               CAST(l_extendedprice AS DOUBLE) AS turnover, {_TIE} AS k FROM lineitem)
  WHERE price > 0 GROUP BY ALL
)"""


BARS = bars()
VWAP = bars(close="round(sum(turnover), 2) / sum(volume)")
EVENT_BARS = """bars AS MATERIALIZED (
  SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_min(value, k) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, k) AS close, CAST(count(*) AS DOUBLE) AS volume, round(sum(value), 2) AS turnover
  FROM (SELECT *, {'a': ts, 'b': event_id} AS k FROM events) WHERE value > 0 GROUP BY ALL
)"""


def frame(first: str, last: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {first} AND {last})"


PREFIX = frame("UNBOUNDED PRECEDING")
LAG = "(PARTITION BY symbol ORDER BY ts)"


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    over = frame(f"{n - 1} PRECEDING")
    return f"CASE WHEN count({x}) OVER {over} >= {n if least is None else least} THEN {agg}({x}) OVER {over} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {LAG}"


def zscore(x: str, n: int = 100) -> str:
    sd = roll("stddev_pop", x, n, n // 2)
    return f"({x} - ({roll('avg', x, n, n // 2)})) / nullif({sd}, 0)"


def ewm(name: str, source: str, columns: dict[str, tuple[str, float]]) -> str:
    """A recursive CTE (symbol, n, outputs) over ``source`` (symbol, n from 1, inputs): seeds at the first
    value; later inputs must not be NULL."""
    seed = ", ".join(f"CAST({x} AS DOUBLE) AS {y}" for y, (x, _) in columns.items())
    step = ", ".join(f"CASE WHEN e.{y} IS NULL THEN s.{x} ELSE (1 - {a!r}) * e.{y} + {a!r} * s.{x} END" for y, (x, a) in columns.items())
    return f"""{name} AS (
  SELECT symbol, n, {seed} FROM {source} WHERE n = 1
  UNION ALL SELECT s.symbol, s.n, {step} FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.n = e.n + 1
)"""


def numbered(name: str, columns: str, source: str = "bars") -> str:
    return f"{name} AS MATERIALIZED (SELECT symbol, ts, row_number() OVER {LAG} AS n, {columns} FROM {source})"


TRUE_RANGE = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


def with_atr(source: str = "bars", n: int = 14) -> str:
    """CTEs atr_in, atr_e and atr (all of the source's columns, n and atr_14)."""
    return f"""{numbered("atr_in", f"*EXCLUDE (symbol, ts), {TRUE_RANGE} AS tr", source)},
{ewm("atr_e", "atr_in", {"y": ("tr", 1 / n)})},
atr AS MATERIALIZED (SELECT i.*, CASE WHEN i.n >= {n} THEN e.y END AS atr_14 FROM atr_in i JOIN atr_e e USING (symbol, n))"""


#: A pivot rule that SQL can express: the extreme of the five rows around it, kept where kinds alternate.
PIVOTS = f"""ext AS (
  SELECT symbol, ts, CASE WHEN high = max(high) OVER {frame('2 PRECEDING', '2 FOLLOWING')} THEN 1 WHEN low = min(low) OVER {frame('2 PRECEDING', '2 FOLLOWING')} THEN -1 END AS kind,
         high, low FROM bars
), piv AS MATERIALIZED (
  SELECT symbol, ts, CASE WHEN kind = 1 THEN high ELSE low END AS price, kind
  FROM (SELECT *, lag(kind) OVER {LAG} AS k1 FROM ext WHERE kind IS NOT NULL) WHERE k1 IS NULL OR kind <> k1
)"""

#: Inputs of the signal operators that both engines can compute: plain averages in place of
#: exponential ones and scaled moves in place of directional averages. Same text for both engines.
SIGNAL_INPUTS = """
SELECT symbol, ts, close, ema20, ema50, atr_pct, trend_align, rsi, bb_pct_b, bb_z, bb_mid, bb_width_pctl, macd_hist_slope, macd_hist_z,
       donch_break_strength, 50.0 + 20.0 * trend_align AS plus_di, 50.0 - 20.0 * trend_align AS minus_di,
       16.0 + 12.0 * abs(trend_align) AS adx,
       CAST(CASE WHEN trend_align > 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS is_trend_up,
       CAST(CASE WHEN trend_align < -0.5 THEN 1 ELSE 0 END AS DOUBLE) AS is_trend_dn,
       CAST(CASE WHEN abs(trend_align) < 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS is_range,
       CAST(CASE WHEN n % 17 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS is_chop
FROM (
  SELECT symbol, ts, n, close, ema20, ema50, (high - low) / close AS atr_pct,
         (sign(ema20 - ema50) + sign(close - ema50) + sign(close - ema20)) / CAST(3 AS DOUBLE) AS trend_align,
         50.0 + 20.0 * (close - ema20) / sd AS rsi, (close - (ema20 - 2.0 * sd)) / (4.0 * sd) AS bb_pct_b, (close - ema20) / sd AS bb_z,
         ema20 AS bb_mid, CAST(n % 10 AS DOUBLE) / 10.0 AS bb_width_pctl, close - prev AS macd_hist_slope, (close - ema50) / sd AS macd_hist_z,
         (close - top) / (high - low) AS donch_break_strength
  FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n,
           avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ema20,
           avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS ema50,
           stddev_pop(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd,
           max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS top,
           lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev
    FROM bars
  ) a WHERE n > 50 AND sd > 0 AND high > low
) b
"""
