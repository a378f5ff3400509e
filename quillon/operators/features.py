"""Feature operators: each adds its columns to a table of bars.

What has a bounded frame is a window expression over (symbol, ts), and all of those share one
exchange and sort; the recursions behind exponential averages are kernels (see recursions).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.windows import (
    by_time,
    bfill,
    changed,
    clip,
    cumulative,
    ffill,
    flag,
    full_pct_rank,
    holds,
    pct_rank,
    position_in_run,
    ratio,
    rolling,
    zscore,
)
from quillon.operators import machines
from quillon.operators import recursions as R
from quillon.params import FeatureParams
from quillon.storage import stage

FIB_LEVELS = (0.236, 0.382, 0.5, 0.618, 0.786)


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_time())


def log_return(x: str = "close") -> Column:
    return F.ln(x) - lag(F.ln(F.col(x)))


def add_returns(bars: DataFrame) -> DataFrame:
    """log_ret, vol_20, vol_64, price_z."""
    df = bars.withColumn("log_ret", log_return())
    return df.withColumns(
        {
            "vol_20": rolling(F.stddev_samp, F.col("log_ret"), 20),
            "vol_64": rolling(F.stddev_samp, F.col("log_ret"), 64),
            "price_z": zscore(F.col("close"), 100),
        }
    )


def true_range() -> Column:
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def add_atr(bars: DataFrame, n: int = 14, name: str = "atr_14") -> DataFrame:
    df = bars.withColumn("__tr", true_range())
    df = R.per_symbol(df, lambda p: {name: R.wilder(p["__tr"], n)}, {name: "double"})
    return df.drop("__tr")


def add_bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    close = F.col("close")
    mid, sd = rolling(F.avg, close, n, n // 2), rolling(F.stddev_pop, close, n, n // 2)
    df = bars.withColumns({"bb_mid": mid, "__sd": sd})
    df = df.withColumns({"bb_upper": F.col("bb_mid") + k * F.col("__sd"), "bb_lower": F.col("bb_mid") - k * F.col("__sd")})
    band = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns(
        {
            "bb_width": ratio(band, F.col("bb_mid")),
            "bb_pct_b": ratio(close - F.col("bb_lower"), band),
            "bb_z": ratio(close - F.col("bb_mid"), F.col("__sd")),
        }
    ).drop("__sd")


def _run_lengths(df: DataFrame, names: dict[str, Column]) -> DataFrame:
    """For each condition the number of rows it has held so far (0 where it doesn't)."""
    for name, condition in names.items():
        df = df.withColumn("__on", flag(condition)).withColumn("__new", changed(F.col("__on")))
        df = df.withColumn("__run", cumulative(F.col("__new")))
        df = df.withColumn(name, F.when(F.col("__on") > 0, position_in_run("__run").cast("double")).otherwise(0.0))
    return df.drop("__on", "__new", "__run")


def add_stochastic(bars: DataFrame, k: int = 14, d: int = 3, smooth: int = 3) -> DataFrame:
    low, high = rolling(F.min, F.col("low"), k), rolling(F.max, F.col("high"), k)
    df = bars.withColumns({"__low": low, "__high": high})
    df = df.withColumn("__fast", ratio(100 * (F.col("close") - F.col("__low")), F.col("__high") - F.col("__low")))
    df = df.withColumn("__slow", rolling(F.avg, F.col("__fast"), smooth))
    df = df.withColumns({"stoch_k": F.col("__slow") / 100, "stoch_spread": F.col("__slow") - rolling(F.avg, F.col("__slow"), d)})
    df = _run_lengths(df, {"stoch_oversold_dur": F.col("__slow") < 20, "stoch_overbought_dur": F.col("__slow") > 80})
    return df.drop("__low", "__high", "__fast", "__slow")


def add_donchian(bars: DataFrame, n: int = 20, atr: str = "atr_14") -> DataFrame:
    """Needs the column ``atr``."""
    close = F.col("close")
    df = bars.withColumns({"__up": rolling(F.max, F.col("high"), n), "__dn": rolling(F.min, F.col("low"), n)})
    df = df.withColumns({"__up1": lag("__up"), "__dn1": lag("__dn"), "__c1": lag("close")})
    width = F.col("__up") - F.col("__dn")
    a = F.col(atr)
    return df.withColumns(
        {
            "donch_pos": ratio(close - F.col("__dn"), width),
            "donch_width_atr": ratio(width, a),
            "donch_break_up": flag((close > F.col("__up1")) & (F.col("__c1") <= F.col("__up1"))),
            "donch_break_dn": flag((close < F.col("__dn1")) & (F.col("__c1") >= F.col("__dn1"))),
            "donch_break_strength": ratio(close - F.col("__up1"), a),
            "donch_mid_dist_atr": ratio(close - (F.col("__up") + F.col("__dn")) / 2, a),
        }
    ).drop("__up", "__dn", "__up1", "__dn1", "__c1")


def add_hawkes(df: DataFrame, decay: float = 0.1, gain: float = 1.0, events: Column | None = None) -> DataFrame:
    """Decayed number of breakouts, or of ``events``."""
    found = clip(F.col("donch_break_up") + F.col("donch_break_dn"), 0, 1) if events is None else events
    R.decayed_count([], decay)  # checks the decay
    df = df.withColumn("__x", found)
    return R.per_symbol(df, lambda p: {"hawkes_intensity": R.decayed_count(p["__x"], decay, gain)}, {"hawkes_intensity": "double"}).drop("__x")


def add_emas(bars: DataFrame, spans: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    names = {f"ema{n}": n for n in spans}
    return R.per_symbol(bars, lambda p: {c: R.ema(p["close"], n) for c, n in names.items()}, dict.fromkeys(names, "double"))


def add_ema_stack(df: DataFrame) -> DataFrame:
    """Slopes and alignment of ema20, ema50 and ema200, which must be there."""
    sign = lambda x: F.coalesce(F.signum(x), F.lit(0.0))
    align = sign(F.col("ema20") - F.col("ema50")) + sign(F.col("ema50") - F.col("ema200")) + sign(F.col("close") - F.col("ema200"))
    slopes = {f"ema{n}_slope": ratio(F.col(f"ema{n}") - lag(f"ema{n}", k), lag(f"ema{n}", k)) for n, k in ((20, 5), (50, 10), (200, 20))}
    return df.withColumns(slopes | {"trend_align": align / 3.0})


def directional_inputs(bars: DataFrame) -> DataFrame:
    """__tr, __plus and __minus: true range and directional moves (NULL on the first row)."""
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    df = bars.withColumns({"__tr": true_range(), "__u": up, "__d": down})
    known = F.col("__u").isNotNull() & F.col("__d").isNotNull()
    move = lambda a, b: F.when(known, F.when((F.col(a) > F.col(b)) & (F.col(a) > 0), F.col(a)).otherwise(0.0))
    return df.withColumns({"__plus": move("__u", "__d"), "__minus": move("__d", "__u")}).drop("__u", "__d")


ADX_COLUMNS = dict.fromkeys(("adx", "plus_di", "minus_di", "adx_norm", "di_spread"), "double")


def add_adx(bars: DataFrame, n: int = 14) -> DataFrame:
    return R.per_symbol(directional_inputs(bars), lambda p: R.adx_kernel(p, n), ADX_COLUMNS).drop("__tr", "__plus", "__minus")


def add_rsi(bars: DataFrame, n: int = 14, name: str = "rsi_14") -> DataFrame:
    df = bars.withColumn("__ch", F.col("close") - lag("close"))
    return R.per_symbol(df, lambda p: {name: R.rsi_kernel(p["__ch"], n)}, {name: "double"}).drop("__ch")


def macd_columns(df: DataFrame) -> DataFrame:
    """The MACD features from __macd and __sig."""
    df = df.withColumn("__hist", F.col("__macd") - F.col("__sig"))
    df = df.withColumns({"macd_hist_z": zscore(F.col("__hist"), 100), "macd_hist_slope": F.col("__hist") - lag("__hist"), "__pz": zscore(F.col("close"), 100)})
    m, s, m1, s1 = F.col("__macd"), F.col("__sig"), lag("__macd"), lag("__sig")
    return df.withColumns(
        {
            "macd_divergence": F.coalesce(F.col("__pz") - F.col("macd_hist_z"), F.lit(0.0)),
            "macd_cross_up": flag((m > s) & (m1 <= s1)),
            "macd_cross_dn": flag((m < s) & (m1 >= s1)),
        }
    ).drop("__macd", "__sig", "__hist", "__pz")


def add_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    added = {"__macd": "double", "__sig": "double"}
    return macd_columns(R.per_symbol(bars, lambda p: R.macd_kernel(p["close"], fast, slow, signal), added))


def add_frac_diff(bars: DataFrame, d: float = 0.4, threshold: float = 1e-5, name: str = "ffd") -> DataFrame:
    return R.per_symbol(bars, lambda p: {name: R.frac_diff(p["close"], d, threshold)}, {name: "double"})


def add_regime_score(df: DataFrame, trend_th: float = 22.0, range_th: float = 18.0, lookback: int = 250) -> DataFrame:
    """Needs adx, bb_width, trend_align and atr_pct. A trend must have lasted 30 bars; ranging overrides it."""
    df = df.withColumns(
        {
            "bb_width_pctl": pct_rank(F.col("bb_width"), lookback, 50),
            "__ap": pct_rank(F.col("atr_pct"), lookback, 50),
            "__sign": F.coalesce(F.signum("trend_align"), F.lit(0.0)),
        }
    )
    df = df.withColumn("__new", changed(F.col("__sign"))).withColumn("__run", cumulative(F.col("__new")))
    df = df.withColumn("__long", position_in_run("__run") >= 30)
    adx, width, align = F.col("adx"), F.col("bb_width_pctl"), F.abs("trend_align")
    strong = holds((adx >= trend_th + 10) & (align >= 1.0)) & F.col("__long")
    weak = holds((adx >= trend_th + 3) & (align >= F.lit(2.0) / F.lit(3.0))) & F.col("__long")
    quiet = (holds(adx <= range_th + 4) | holds(align <= F.lit(1.0) / F.lit(3.0))) & holds(width <= 0.75)
    chop_low = holds((adx <= range_th - 2) & (width <= 0.20) & (F.col("__ap") <= 0.30))
    chop_high = holds((adx <= range_th + 2) & (F.col("__ap") >= 0.85)) & ~F.col("__long")
    df = df.withColumns({"__strong": strong, "__weak": weak, "__quiet": quiet, "__chop": chop_low | chop_high})
    code = F.when(F.col("__quiet"), 0.0).when(F.col("__strong"), F.col("__sign") * 2).when(F.col("__weak"), F.col("__sign")).otherwise(0.0)
    df = df.withColumn("regime_code", code)
    return df.withColumns(
        {
            "is_trend_up": (F.col("regime_code") > 0).cast("double"),
            "is_trend_dn": (F.col("regime_code") < 0).cast("double"),
            "is_range": (F.col("__quiet") & ~F.col("__weak") & ~F.col("__strong") & ~F.col("__chop")).cast("double"),
            "is_chop": F.col("__chop").cast("double"),
        }
    ).drop("__ap", "__sign", "__new", "__run", "__long", "__strong", "__weak", "__quiet", "__chop")


# --- pivots --------------------------------------------------------------------------------------

PIVOTS = "symbol string, ts timestamp_ntz, confirmed timestamp_ntz, price double, kind int"


def zigzag_pivots(bars: DataFrame, mult: float = 3.0, atr: str = "atr_14", streamed: bool = False) -> DataFrame:
    """Pivots (symbol, ts, confirmed, price, kind) of moves of more than ``mult`` ATR. Needs ``atr``. ``streamed``: a symbol's
    rows needn't fit in memory."""
    if streamed:
        return machines.run(bars.select("symbol", "ts", "high", "low", "close", (bfill(F.col(atr)) * mult).alias("move")), "ts", machines.Zigzag)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        found = R.zigzag(*(pdf[c].to_numpy() for c in ("high", "low", "close")), (pdf[atr].bfill() * mult).to_numpy())
        at, seen, price, kind = zip(*found, strict=True) if found else ((), (), (), ())
        ts = pdf["ts"].to_numpy()
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "ts": ts[list(at)], "confirmed": ts[list(seen)], "price": np.array(price, float), "kind": np.array(kind, np.int32)})

    return bars.select("symbol", "ts", "high", "low", "close", atr).groupBy("symbol").applyInPandas(run, PIVOTS)


def as_of_pivots(bars: DataFrame, pivots: DataFrame, n: int, at: str = "ts") -> DataFrame:
    """``bars`` with __p: the last n pivots at or before each bar as an array, oldest first (NULL before
    the n-th), and __n: how many there are. ``at``: "ts" (the extreme's bar) or "confirmed".

    No range join: pivots carry their predecessors and join the bars they lie on, and the last value
    is carried forward.
    """
    order = Window.partitionBy("symbol").orderBy("ts")
    one = F.struct("price", "kind")
    past = F.collect_list(one).over(order.rowsBetween(-(n - 1), 0))
    own = pivots.select("symbol", F.col(at).alias("__at"), F.when(F.size(past) == n, past).alias("__p"), F.row_number().over(order).alias("__n"))
    # several pivots may be confirmed in one bar: the last one counts
    own = own.groupBy("symbol", F.col("__at").alias("ts")).agg(F.max_by(F.struct("__p", "__n"), "__n").alias("__v"))
    joined = bars.join(own, ["symbol", "ts"], "left").withColumn("__v", ffill(F.col("__v")))
    return joined.select(*bars.columns, F.col("__v.__p").alias("__p"), F.coalesce(F.col("__v.__n"), F.lit(0)).alias("__n"))


def add_fibonacci(bars: DataFrame, pivots: DataFrame, atr: str = "atr_14", at: str = "ts") -> DataFrame:
    """Distance to the nearest retracement level of the last swing in ATR, that level, and whether the
    close lies in the zone from 0.5 to 0.618. Neutral values before a swing."""
    df = as_of_pivots(bars.withColumn("__a", F.greatest(bfill(F.col(atr)), F.lit(1e-9))), pivots, 2, at)
    first, last = F.col("__p")[0]["price"], F.col("__p")[1]["price"]
    swing = last - first
    level = lambda r: last - r * swing
    options = F.array(*(F.struct((F.abs(level(r) - F.col("close")) / F.col("__a")).alias("d"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(FIB_LEVELS)))
    known = holds(F.col("__p").isNotNull() & (swing != 0))
    inside = F.col("close").between(F.least(level(0.618), level(0.5)), F.greatest(level(0.618), level(0.5)))
    df = df.withColumn("__best", F.when(known, F.array_min(options)))
    return df.withColumns(
        {
            "fib_nearest_dist_atr": F.coalesce(F.col("__best.d"), F.lit(999.0)),
            "fib_nearest_level": F.coalesce(F.col("__best.r"), F.lit(0.5)),
            "fib_in_golden_zone": F.when(known, inside.cast("double")).otherwise(0.0),
        }
    ).drop("__p", "__n", "__a", "__best")


def add_elliott(bars: DataFrame, pivots: DataFrame, at: str = "ts") -> DataFrame:
    """Share of five impulse rules that the last six pivots meet (ew_confidence), wave id 5 from 0.6 on,
    and tags by the number of pivots so far."""
    df = as_of_pivots(bars, pivots, 6, at)
    price = [F.col("__p")[i]["price"] for i in range(6)]
    up = F.when(F.col("__p")[0]["kind"] == -1, 1.0).otherwise(-1.0)
    waves = {f"__w{i}": (price[i] - price[i - 1]) * up * (1 if i % 2 else -1) for i in range(1, 6)}
    df = df.withColumns(waves | {"__dir": up})
    w1, w2, w3, w4, w5 = (F.col(f"__w{i}") for i in range(1, 6))
    valid = holds(F.least(w1, w2, w3, w4, w5) > 0) & F.col("__p").isNotNull()
    fourth, first = price[3] - F.col("__dir") * w4, price[0] + F.col("__dir") * w1
    rules = (
        ratio(w2, w1).between(0.382, 0.786),
        w3 >= 1.618 * w1,
        (w3 >= w1) & (w3 >= w5),
        (fourth - first) * F.col("__dir") > 0,
        ratio(w5, w1).between(0.382, 1.618),
    )
    met = sum((holds(r).cast("int") for r in rules), F.lit(0))
    df = df.withColumn("ew_confidence", F.when(valid, met / F.lit(5.0)).otherwise(0.0))
    sure, segment = F.col("ew_confidence") >= 0.6, (F.col("__n") - 1) % 5 + 1
    return df.withColumns(
        {
            "ew_wave_id": F.when(sure, 5).otherwise(0),
            "ew_in_wave3": (sure & (segment == 3)).cast("double"),
            "ew_in_wave5": (sure & (segment == 5)).cast("double"),
        }
    ).drop("__p", "__n", "__dir", *waves)


# --- regimes -------------------------------------------------------------------------------------


def add_hurst(bars: DataFrame, window: int = 256, max_lag: int = 64) -> DataFrame:
    """Slope of log deviation of lagged differences against log lag, over the ``window`` rows before each
    row. Lags without deviation are left out and the rest renumbered."""
    if window < 2 * max_lag:
        raise ValueError("the window must hold at least twice the largest lag")
    return R.per_symbol(bars, lambda p: {"hurst": R.rolling_hurst(p["close"], window, max_lag)}, {"hurst": "double"})


def add_vol_regime(df: DataFrame, n: int = 64) -> DataFrame:
    """regime 0, 1 or 2 by the rank of rolling volatility among all of the symbol's. Looks ahead."""
    filled = df.withColumn("__v", rolling(F.stddev_samp, F.coalesce("log_ret", F.lit(0.0)), n))
    filled = filled.withColumn("__q", full_pct_rank(F.col("__v")))
    q = F.col("__q")
    return filled.withColumn("regime", F.when(q <= 0.33, 0.0).when(q <= 0.66, 1.0).when(q <= 1.01, 2.0)).drop("__v", "__q")


def add_hmm_regime(df: DataFrame, n_states: int = 3) -> DataFrame:
    return R.per_symbol(df, lambda p: {"regime": R.gaussian_regimes(p["log_ret"], n_states)}, {"regime": "double"})


# --- the matrix ----------------------------------------------------------------------------------

MATRIX = (
    "close", "log_ret", "vol_20", "vol_64", "ffd", "price_z", "atr_14", "atr_pct",
    "macd_hist_z", "macd_hist_slope", "macd_divergence", "macd_cross_up", "macd_cross_dn",
    "stoch_k", "stoch_spread", "stoch_oversold_dur", "stoch_overbought_dur",
    "donch_pos", "donch_width_atr", "donch_break_up", "donch_break_dn", "donch_break_strength", "donch_mid_dist_atr",
    "hawkes_intensity",
    "ema20", "ema50", "ema200", "ema20_slope", "ema50_slope", "ema200_slope", "trend_align",
    "adx", "plus_di", "minus_di", "adx_norm", "di_spread", "rsi",
    "bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct_b", "bb_z",
    "regime_code", "is_trend_up", "is_trend_dn", "is_range", "is_chop", "bb_width_pctl",
    "fib_nearest_dist_atr", "fib_nearest_level", "fib_in_golden_zone",
    "ew_wave_id", "ew_confidence", "ew_in_wave3", "ew_in_wave5", "hurst", "regime",
)


def feature_matrix(bars: DataFrame, params: FeatureParams | None = None, pivot_time: str = "ts", hmm: bool = False) -> DataFrame:
    """symbol, ts and the columns of MATRIX for every bar; NULL while there isn't enough history.

    One kernel pass makes all recursions of prices, and is written once; a second makes the Hawkes
    intensity, a third the pivots.
    ``pivot_time`` "ts" looks ahead, as the extreme is known later; "confirmed" doesn't.
    """
    p = params or FeatureParams()

    def kernel(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        close = pdf["close"]
        return (
            {"ffd": R.frac_diff(close, p.frac_d), "atr_14": R.wilder(pdf["__tr"], 14), "rsi": R.rsi_kernel(close.diff(), p.rsi_n)}
            | {"hurst": R.rolling_hurst(close)}
            | {f"ema{n}": R.ema(close, n) for n in (20, 50, 200)}
            | R.macd_kernel(close, p.macd_fast, p.macd_slow, p.macd_signal)
            | R.adx_kernel(pdf, p.adx_n)
        )

    added = dict.fromkeys(("ffd", "atr_14", "rsi", "hurst", "ema20", "ema50", "ema200", "__macd", "__sig"), "double") | ADX_COLUMNS
    df = stage(R.per_symbol(directional_inputs(bars), kernel, added).drop("__tr", "__plus", "__minus"), "recursions")
    pivots = zigzag_pivots(df, p.zigzag_atr_mult)
    df = add_returns(macd_columns(df)).withColumn("atr_pct", ratio(F.col("atr_14"), F.col("close")))
    df = add_donchian(add_stochastic(df, p.stoch_k, p.stoch_d, p.stoch_smooth), p.donch_n)
    df = add_bollinger(add_ema_stack(df), p.bb_n, p.bb_k)
    df = add_regime_score(df, p.adx_trend_th, p.adx_range_th)
    df = add_elliott(add_fibonacci(df, pivots, at=pivot_time), pivots, at=pivot_time)
    df = add_hmm_regime(df, p.regime_states) if hmm else add_vol_regime(df)
    df = add_hawkes(df, p.hawkes_decay).withColumn("regime", ffill(F.col("regime")))
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(c)
    return df.select("symbol", "ts", *(finite(c) for c in MATRIX))


def with_parameter_names(matrix: DataFrame, params: FeatureParams | None = None) -> DataFrame:
    """The matrix with the two columns whose names carry their parameter: ffd_{d} and rsi_{n}."""
    p = params or FeatureParams()
    return matrix.withColumnsRenamed({"ffd": f"ffd_{p.frac_d}", "rsi": f"rsi_{p.rsi_n}"})


def min_stationary_d(bars: DataFrame, level: float = 0.05, grid: tuple[float, ...] = tuple(i / 10 for i in range(11))) -> DataFrame:
    """(symbol, d, statistic, p_value): the smallest d of the grid whose differenced close passes an
    augmented Dickey-Fuller test (constant, one lag) at ``level``; 1.0 and no statistic if none does."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        close = pdf.sort_values("ts")["close"].to_numpy()
        found = (1.0, np.nan, np.nan)
        for d in grid:
            x = R.frac_diff(close, d)
            x = x[~np.isnan(x)]
            if len(x) < 100:
                continue
            statistic = R.adf_statistic(x)
            p = R.adf_p_value(statistic)
            if p < level:
                found = (d, statistic, p)
                break
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "d": [found[0]], "statistic": [found[1]], "p_value": [found[2]]})

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandas(run, "symbol string, d double, statistic double, p_value double")
