"""Streams give what the batch operators give."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import recursions as R
from quillon.sources import bars as B
from quillon.streaming import live

T0 = dt.datetime(2024, 1, 1)
TICK = "symbol string, ts timestamp, price double, volume double, turnover double, tie bigint"


def write_parts(spark, rows, schema, path, parts):
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(path)


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_bars(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("X", T0 + dt.timedelta(seconds=20 * i), float(p), 1.0, float(p), i) for i, p in enumerate(100 + rng.normal(0, 1, 400).cumsum())]
    path = str(tmp_path / "ticks")
    write_parts(spark, rows, TICK, path, 4)
    stream = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r["ts"]: r["close"] for r in run(live.streaming_bars(stream, "5 minutes"), "bars").collect()}
    want = {r["ts"]: r["close"] for r in B.time_bars(spark.read.parquet(path), "5 minutes").collect()}
    assert len(got) >= len(want) - 2 and all(want[k] == v for k, v in got.items())


def test_recursive_features_carry_state_over_batches(spark, tmp_path):
    close = 100 * np.exp(np.random.default_rng(2).normal(0, 0.01, 200).cumsum())
    rows = [("X", T0 + dt.timedelta(minutes=i), float(c)) for i, c in enumerate(close)]
    schema, path = "symbol string, ts timestamp, close double", str(tmp_path / "bars")
    write_parts(spark, rows, schema, path, 5)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(live.recursive_features(stream), "features").orderBy("ts").toPandas()
    np.testing.assert_allclose(got["ema"], R.ewm_mean(close, 2 / 21))
    np.testing.assert_allclose(got["hawkes"], R.decayed_count(got["event"], 0.1))
    assert got["event"].iloc[:20].sum() == 0
    assert live.order_intents(spark.createDataFrame(got)).count() == int(((got["event"] == 1) & ~got["cooling"]).sum())


def test_drift_and_sink(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("X", T0 + dt.timedelta(minutes=i), float(x)) for i, x in enumerate(np.concatenate([rng.normal(0, 1, 60), rng.normal(3, 1, 90)]))]
    schema, path, out = "symbol string, ts timestamp, x double", str(tmp_path / "x"), str(tmp_path / "out")
    write_parts(spark, rows, schema, path, 3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    drifted = live.drift_monitor(stream, {"X": rng.normal(0, 1, 500).tolist()})
    live.append_to(drifted, out, str(tmp_path / "ckpt"), once=True).awaitTermination()
    got = spark.read.parquet(out).orderBy("ts").collect()
    assert len(got) == 150 and not got[40]["drift"] and got[-1]["drift"]
    assert spark.read.parquet(out).filter(F.col("rows") < 50).filter("drift").count() == 0
