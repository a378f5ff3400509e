"""Machines that stream rows give what the kernels give that hold a symbol."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_blocks import BARS, series

from quillon.operators import backtest, features, labels, machines


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def rows_of(df, *by):
    return df.toPandas().sort_values(list(by), ignore_index=True)


def test_streamed_operators_in_many_batches(spark, small_batches):
    bars = features.add_atr(spark.createDataFrame(series(), BARS)).cache()
    for mult in (0.5, 2.0):
        got, want = (rows_of(features.zigzag_pivots(bars, mult, streamed=s), "symbol", "ts") for s in (True, False))
        pd.testing.assert_frame_equal(got[list(want)], want, check_dtype=False)
        assert len(got) > 5
    got, want = (rows_of(labels.cusum_events(bars, streamed=s), "symbol", "ts") for s in (True, False))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    rng = np.random.default_rng(2)
    spans = [("ab"[i % 2], int(e), int(e + rng.integers(0, 9)), i) for i, e in enumerate(np.sort(rng.choice(900, 300, False)))]
    trades = spark.createDataFrame(spans, "symbol string, e bigint, exit_n bigint, k int")
    got, want = (rows_of(backtest.one_position(trades, streamed=s), "symbol", "e") for s in (True, False))
    pd.testing.assert_frame_equal(got[list(want)], want, check_dtype=False)
    bars.unpersist()


def test_five_million_bars_of_a_symbol_in_batches(spark):
    """A batch is the most that a machine ever sees, and its state is two numbers."""

    class Watched(machines.Cusum):
        def step(self, rows):
            assert len(rows["r"]) <= 10_000 and len(self.carry) == 2
            return super().step(rows)

    n = 5_000_000
    df = spark.range(n).select(F.lit("one").alias("symbol"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), (F.pmod(F.col("id"), 10) - 4.5).alias("r"), F.lit(9.0).alias("h"))
    got = machines.run(df, "ts", Watched).agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")).first()
    up = down = events = 0
    for i in range(1000):  # the pattern repeats
        r = i % 10 - 4.5
        up, down = max(0.0, up + r), min(0.0, down + r)
        if up > 9:
            up, events = 0.0, events + 1
        elif down < -9:
            down, events = 0.0, events + 1
    assert got[0] == pytest.approx(events * n / 1000, rel=0.01) and got[1] < got[2]


def test_no_rows(spark):
    none = spark.createDataFrame([], "symbol string, ts timestamp_ntz, r double, h double")
    assert machines.run(none, "ts", machines.Cusum).count() == 0
