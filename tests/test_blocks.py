"""Block-wise features against the operators that hold a symbol, and against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import windows as W
from quillon.functions.blocks import BLOCK, Blocks, pct_ranks
from quillon.operators import features, labels, long_series, scans

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, turnover double"


def series(n=700, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for k, symbol in enumerate(("a", "b/1", "c")):
        m = (n, n // 3, 5)[k]
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, m)))
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 9, m)), unit="h")
        wide = np.abs(rng.normal(0, 1, m))
        out.append(pd.DataFrame({"symbol": symbol, "ts": ts, "open": close, "high": close + wide, "low": close - wide, "close": close, "volume": 1.0, "turnover": close}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(series(), BARS)


def same(got, want, *columns):
    left, right = (df.select("symbol", "ts", *columns).toPandas().sort_values(["symbol", "ts"], ignore_index=True) for df in (got, want))
    pd.testing.assert_frame_equal(left, right, rtol=1e-9, atol=1e-9)
    assert left[list(columns)].notna().any().all()


def test_rows_are_numbered_without_a_window_over_the_symbol(bars):
    got = Blocks.of(bars, 100).df.toPandas().sort_values(["symbol", "ts"])
    assert (got["__n"] == got.groupby("symbol").cumcount()).all() and (got[BLOCK] == got["__n"] // 100).all()


@pytest.mark.parametrize("rows", [101, 5000])
def test_features_by_blocks(bars, rows):
    b = Blocks.of(bars, rows)
    same(long_series.add_emas(b).bars(), features.add_emas(bars), "ema20", "ema50", "ema200")
    same(long_series.add_atr(b).bars(), features.add_atr(bars), "atr_14")
    same(long_series.add_rsi(b).bars(), features.add_rsi(bars), "rsi_14")
    same(long_series.add_adx(b).bars(), features.add_adx(bars), *features.ADX_COLUMNS)
    macd = ("macd_hist_z", "macd_hist_slope", "macd_divergence", "macd_cross_up", "macd_cross_dn")
    same(long_series.add_macd(b).bars(), features.add_macd(bars), *macd)
    events = W.flag(F.col("close") > F.col("open") * 0 + 100)
    same(long_series.add_hawkes(b, 0.1, events=events).bars(), features.add_hawkes(bars, 0.1, events=events), "hawkes_intensity")
    same(long_series.add_vol_regime(b), features.add_vol_regime(features.add_returns(bars)), "regime")
    same(long_series.daily_volatility(bars, rows=rows), labels.daily_volatility(bars), "target_vol")


def test_scans_are_the_same_in_any_blocks():
    rng = np.random.default_rng(5)
    x = rng.normal(3, 1, 400)
    x[rng.random(400) < 0.3] = np.nan
    x[:7] = x[150:260] = np.nan
    plain = {
        scans.Mean(0.5, 3): pd.Series(x).ewm(alpha=0.5, adjust=False, min_periods=3).mean(),
        scans.ema(20): pd.Series(x).ewm(span=20, adjust=False, min_periods=20).mean(),
        scans.Deviation(100, 20): pd.Series(x).ewm(span=100, min_periods=20).std(),
        scans.Deviation(5, 0): pd.Series(x).ewm(span=5).std(),
        scans.Last(): pd.Series(x).ffill(),
    }
    for scan, want in plain.items():
        for size in (1, 7, 100, 400):
            state, got = scan.start(), []
            for i in range(0, 400, size):
                got.append(scan.run(x[i : i + size], state))
                state = scan.after(state, scan.summary(x[i : i + size]))
            np.testing.assert_allclose(np.concatenate(got), want, rtol=1e-9, atol=1e-12)


def test_ranks_with_ties_nulls_and_a_common_value(spark):
    rng = np.random.default_rng(1)
    x = [None if v > 8 else float(min(v, 3)) for v in rng.integers(0, 10, 500)]
    df = spark.createDataFrame([("ab"[i % 2], i, v) for i, v in enumerate(x)], "symbol string, i int, x double")
    got = pct_ranks(df, "x", "q").toPandas().sort_values("i", ignore_index=True)
    want = got.groupby("symbol")["x"].rank(pct=True)
    pd.testing.assert_series_equal(got["q"], want, check_names=False)


def test_no_task_holds_the_symbol(spark, monkeypatch):
    """A million rows of one symbol: every kernel gets a block at most."""
    n, rows = 1_000_000, 100_000
    df = spark.range(n).select(F.lit("one").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), (F.sin(F.col("id") / 50) + 2).alias("close"))

    class Watched(scans.Mean):
        def run(self, x, state):
            assert len(x) <= 100_000
            return super().run(x, state)

        def summary(self, x):
            assert len(x) <= 100_000
            return super().summary(x)

    out = Blocks.of(df, rows).scan({"y": ("close", Watched(0.1))}).bars()
    got = out.agg(F.count("y"), F.max(F.struct("ts", "y"))["y"]).first()
    want = pd.Series(np.sin(np.arange(n) / 50) + 2).ewm(alpha=0.1, adjust=False).mean().iloc[-1]
    assert got[0] == n and abs(got[1] - want) < 1e-9


def test_edges(spark, bars):
    assert Blocks.of(bars.limit(0), 10).scan({"y": ("close", scans.ema(3))}).bars().count() == 0
    with pytest.raises(ValueError):
        Blocks.of(bars, 10).windows(11, lambda df: df)
    with pytest.raises(ValueError):
        scans.Count(1.5)
