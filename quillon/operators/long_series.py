"""Feature operators over blocks of a series (functions.blocks), with the columns of their counterparts in features.

No task holds a symbol's rows: what has a bounded frame runs over blocks with a halo, exponential averages
and other recursions are scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.blocks import ROWS, Blocks, pct_ranks
from quillon.functions.windows import clip, ratio, rolling
from quillon.operators import features, scans
from quillon.operators.labels import DAY_MICROS


def add_emas(b: Blocks, spans: tuple[int, ...] = (20, 50, 200)) -> Blocks:
    return b.scan({f"ema{n}": ("close", scans.ema(n)) for n in spans})


def add_atr(b: Blocks, n: int = 14, name: str = "atr_14") -> Blocks:
    ranged = b.windows(1, lambda df: df.withColumn("__tr", features.true_range()))
    return _without(ranged.scan({name: ("__tr", scans.wilder(n))}), "__tr")


def add_hawkes(b: Blocks, decay: float = 0.1, gain: float = 1.0, events: Column | None = None) -> Blocks:
    """Decayed number of breakouts (donch_break_up, donch_break_dn), or of ``events``, on columns of ``b``."""
    found = clip(F.col("donch_break_up") + F.col("donch_break_dn"), 0, 1) if events is None else events
    return _without(b.with_columns({"__x": found}).scan({"hawkes_intensity": ("__x", scans.Count(decay, gain))}), "__x")


def add_rsi(b: Blocks, n: int = 14, name: str = "rsi_14") -> Blocks:
    def changes(df: DataFrame) -> DataFrame:
        change = F.col("close") - features.lag("close")
        return df.withColumns({"__gain": clip(change, low=0), "__loss": clip(-change, low=0)})

    moved = b.windows(1, changes).scan({"__g": ("__gain", scans.wilder(n)), "__l": ("__loss", scans.wilder(n))})
    rsi = 100 - 100 / (1 + ratio(F.col("__g"), F.col("__l")))
    return _without(moved.with_columns({name: rsi}), "__gain", "__loss", "__g", "__l")


def add_adx(b: Blocks, n: int = 14) -> Blocks:
    """Two scans: the index is an average of a ratio of averages."""
    moves = b.windows(1, features.directional_inputs).scan({f"__w{c}": (c, scans.wilder(n)) for c in ("__tr", "__plus", "__minus")})
    di = {name: ratio(100 * F.col(f"__w{c}"), F.col("__w__tr")) for name, c in (("plus_di", "__plus"), ("minus_di", "__minus"))}
    plus, minus = F.col("plus_di"), F.col("minus_di")
    moves = moves.with_columns(di).with_columns({"__dx": F.coalesce(ratio(100 * F.abs(plus - minus), plus + minus), F.lit(0.0))})
    out = moves.scan({"adx": ("__dx", scans.wilder(n))})
    out = out.with_columns({"adx_norm": clip(F.col("adx") / 100, 0, 1), "di_spread": plus - minus})
    return _without(out, "__tr", "__plus", "__minus", "__w__tr", "__w__plus", "__w__minus", "__dx")


def add_macd(b: Blocks, fast: int = 12, slow: int = 26, signal: int = 9) -> Blocks:
    both = b.scan({"__fast": ("close", scans.ema(fast)), "__slow": ("close", scans.ema(slow))})
    both = both.with_columns({"__macd": F.col("__fast") - F.col("__slow")}).scan({"__sig": ("__macd", scans.ema(signal))})
    return _without(both.windows(101, features.macd_columns), "__fast", "__slow")


def add_vol_regime(b: Blocks, n: int = 64) -> DataFrame:
    """Bars with log_ret and regime, the third of the symbol's rolling volatilities that a bar's lies in. Looks ahead."""
    def volatility(df: DataFrame) -> DataFrame:
        df = df.withColumn("log_ret", features.log_return())
        return df.withColumn("__v", rolling(F.stddev_samp, F.coalesce("log_ret", F.lit(0.0)), n))

    ranked = pct_ranks(b.windows(n, volatility).bars(), "__v", "__q")
    q = F.col("__q")
    return ranked.withColumn("regime", F.when(q <= 0.33, 0.0).when(q <= 0.66, 1.0).when(q <= 1.01, 2.0)).drop("__v", "__q")


def daily_volatility(bars: DataFrame, span: int = 100, rows: int = ROWS) -> DataFrame:
    """(symbol, ts, target_vol) as in labels. Each bar's close counts from a day and a microsecond later on, so that
    the last one to count is the bar before the first within the last day."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    asks = bars.select("symbol", micros.alias("__at"), F.lit(1).alias("__kind"), F.col("close").alias("__now"), F.lit(None).cast("double").alias("__old"), "ts")
    gives = bars.select("symbol", (micros + DAY_MICROS + 1).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("double").alias("__now"), F.col("close").alias("__old"), F.lit(None).cast(bars.schema["ts"].dataType).alias("ts"))
    met = Blocks.of(asks.unionByName(gives), rows, ("__at", "__kind")).scan({"__before": ("__old", scans.Last())})
    returns = met.df.filter("__kind = 1").select("symbol", "ts", (F.col("__now") / F.col("__before") - 1).alias("__r"))
    return Blocks.of(returns, rows).scan({"target_vol": ("__r", scans.Deviation(span, min(span, 20)))}).bars().select("symbol", "ts", "target_vol")


def _without(b: Blocks, *names: str) -> Blocks:
    return Blocks(b.df.drop(*names), b.rows)
