"""Accounts on a stream against the breakers in batch, over restarts."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import risk
from quillon.params import RiskLimits
from quillon.streaming import account, live

EQUITY = "symbol string, ts timestamp, equity double, side int"
LIMITS = RiskLimits(daily_loss_limit=0.03, max_drawdown=0.15)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    account.use_rocksdb(spark)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_breakers_on_a_stream_are_those_of_batch(spark, tmp_path, rocksdb):
    rng = np.random.default_rng(6)
    rows = []
    for symbol, vol in (("calm", 0.002), ("wild", 0.012)):
        equity = 100 * np.exp(np.cumsum(rng.normal(0, vol, 240)))
        rows += [(symbol, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * i), float(e), 1 if i == 10 else -1 if i == 12 else None) for i, e in enumerate(equity)]
    table = spark.createDataFrame(rows, EQUITY)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    for i, (a, b) in enumerate(((0, 11), (11, 100), (100, 240))):  # each time the query starts anew
        part = [r for r in rows if a <= (r[1] - dt.datetime(2024, 1, 1)) // dt.timedelta(minutes=30) < b]
        spark.createDataFrame(part, EQUITY).coalesce(1).write.mode("append").parquet(source)
        monitor = account.account_monitor(spark.readStream.schema(EQUITY).parquet(source), LIMITS, late="1 minute", valid="3 hours")
        live.append_to(monitor, out, checkpoint, once=True).awaitTermination()
    got = spark.read.parquet(out).toPandas()
    want = risk.breakers(table.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "equity"), LIMITS).toPandas()
    columns = ["daily_return", "drawdown", "halted", "size_multiplier"]
    order = lambda df: df.sort_values(["symbol", "ts"], ignore_index=True)[["symbol", "ts", *columns]]
    pd.testing.assert_frame_equal(order(got[got["kind"] == "equity"]), order(want), check_dtype=False, rtol=1e-9, atol=1e-12)
    assert want["halted"].any() and not want["halted"].all() and 0.5 in set(want["size_multiplier"])
    days = got[got["kind"] == "day closed"]
    assert sorted(days["ts"].dt.day.unique()) == [2, 3, 4, 5] and len(days) == 8
    expired = got[got["kind"] == "signal expired"]
    assert sorted(expired["ts"].unique()) == [pd.Timestamp("2024-01-01 08:00"), pd.Timestamp("2024-01-01 09:00")] and len(expired) == 4
    seen = got[(got["symbol"] == "calm") & (got["kind"] == "equity")].sort_values("ts", ignore_index=True)
    assert seen["long_since"][9] is pd.NaT and seen["long_since"][10] == seen["long_since"][11] == pd.Timestamp("2024-01-01 05:00")
    assert seen["value_at_risk"][:100].isna().all() and seen["value_at_risk"][100:].notna().all()
    equity = [r[2] for r in rows if r[0] == "calm"]
    assert seen["value_at_risk"].iloc[-1] == pytest.approx(-np.quantile(np.diff(equity) / equity[:-1], 0.05))
