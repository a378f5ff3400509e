"""The live step over a bar cache."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import windows as W
from quillon.operators import backtest
from quillon.params import BacktestConfig, RiskLimits, RunnerConfig
from quillon.plans import research
from quillon.sources import bars as B
from quillon.streaming import shadow


def test_shadow_step_judges_the_last_bar_of_symbols_with_enough_history(spark):
    bars = B.synthetic(spark, "trending", 2600, 60).unionByName(B.synthetic(spark, "ranging", 200, 60))
    got = research.shadow_step(bars).collect()
    assert [r["symbol"] for r in got] == ["trending"]
    table = research.signal_table(bars.filter("symbol = 'trending'"), research.Settings())
    last = table.orderBy(F.desc("ts")).first()
    r = got[0]
    assert (r["ts"], r["side"], r["score"], r["price"], r["atr"]) == (last["ts"], last["primary_side"], last["primary_score"], last["close"], last["atr_14"])
    assert r["prob"] is None and r["action"] in ("none", "paper_fill", "halt-drift")
    assert research.shadow_step(bars, runner=RunnerConfig(min_bars=5000)).count() == 0


def said_by_rule(bars, s, model, runner, judged):
    """In place of the features: every fifth minute a side, by the minute."""
    minute = F.unix_seconds(F.col("ts").cast("timestamp")) / 60
    step = (minute / 5).cast("long")
    own = bars.join(judged, ["symbol", "ts"], "left_semi").withColumn("side", F.when(step % 3 == 0, F.when(step % 2 == 0, 1).otherwise(-1)).otherwise(0))
    none = F.lit(None).cast("double")
    action = F.when(F.col("side") != 0, "paper_fill").otherwise("none")
    return own.select("symbol", "ts", "side", F.lit(0.6).alias("score"), (step % 2 + 1).cast("int").alias("mode"), none.alias("prob"), F.col("close").alias("price"), none.alias("atr"), F.lit(0.004).alias("atr_pct"), none.alias("vol_64"), action.alias("action"))


def test_streamed_trades_are_those_of_the_backtest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shadow.research, "shadow_step", lambda bars, s, model, runner, judged: said_by_rule(bars, s, model, runner, judged))
    bars = B.synthetic(spark, "trending", 400, 5).unionByName(B.synthetic(spark, "ranging", 400, 5))
    cache, ledger, wide = str(tmp_path / "cache"), str(tmp_path / "ledger"), RiskLimits(max_concurrent_positions=9, correlation_cap=2.0, var_limit=1.0)
    run = lambda part, i: shadow.shadow_batch(part, i, cache, ledger, research.Settings(), None, RunnerConfig(), wide)
    number = F.row_number().over(W.by_time())
    parts = [bars.withColumn("k", number).filter(c).drop("k") for c in ("k <= 150", "k > 140 AND k <= 170", "k > 170")]  # the second brings bars again
    run(parts[0], 0)
    run(parts[1], 1)
    first = {t: sorted(map(str, spark.read.parquet(f"{ledger}/{t}").collect())) for t in ("fills", "trades", "open")}
    run(parts[1], 1)  # repeated after a failure
    assert first == {t: sorted(map(str, spark.read.parquet(f"{ledger}/{t}").collect())) for t in first} and first["open"]
    run(parts[2], 2)
    fills = spark.read.parquet(f"{ledger}/fills")
    assert fills.count() == fills.select("symbol", "ts").distinct().count() == 800  # every bar is judged once
    signals = fills.select("symbol", "ts", "side", "mode")
    atr = fills.select("symbol", "ts", F.col("atr_pct").alias("atr_frac"))
    want = backtest.run_backtest(bars, signals.filter("side <> 0").select("symbol", "ts"), signals, BacktestConfig(), atr=atr)["trades"].toPandas()
    got = shadow.read_trades(spark, ledger).toPandas()
    columns = [c for c in got.columns if c in want.columns]
    order = lambda df: df.sort_values(["symbol", "entry_time"], ignore_index=True)[columns]
    # the backtest ends trades at the last bar that the stream keeps open
    still = spark.read.parquet(f"{ledger}/open/batch=2").toPandas()
    want = want[~want.set_index(["symbol", "entry_time"]).index.isin(still.set_index(["symbol", "ts"]).index)]
    assert len(got) > 20 and set(got["symbol"]) == {"trending", "ranging"} and {-1, 1} <= set(got["barrier"])
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def test_gates_block_fills(spark):
    bars = B.synthetic(spark, "trending", 300, 5)
    other = bars.withColumn("symbol", F.lit("same"))  # moves as the first does
    third = B.synthetic(spark, "ranging", 300, 5)
    every = bars.unionByName(other).unionByName(third)
    rows = [("trending", 1, "paper_fill"), ("same", 1, "paper_fill"), ("ranging", -1, "paper_fill"), ("quiet", 0, "none")]
    said = spark.createDataFrame(rows, "symbol string, side int, action string").withColumn("ts", F.lit("2024-01-02").cast("timestamp_ntz"))
    held = spark.createDataFrame([("trending", 1)], "symbol string, side int")
    see = lambda limits, halted=False: {r["symbol"]: (r["action"], r["reason"]) for r in shadow.gated(said, held, every, limits, halted).collect()}
    got = see(RiskLimits(var_limit=1.0))
    assert got == {"trending": ("paper_fill", "ok"), "same": ("blocked", "correlation cap vs trending"), "ranging": ("paper_fill", "ok"), "quiet": ("none", None)}
    assert {s for s, (a, _) in see(RiskLimits(var_limit=1.0, correlation_cap=2.0, max_concurrent_positions=2)).items() if a == "blocked"} == {"same"}
    assert all(a == "blocked" for s, (a, _) in see(RiskLimits(), True).items() if s != "quiet")


def test_short_history_is_an_error():
    with pytest.raises(ValueError, match="history_days must be 70"):
        shadow.check_history(research.Settings(), RunnerConfig(interval="60"))
    shadow.check_history(research.Settings(), RunnerConfig())


def test_each_judged_bar_is_judged_as_if_it_were_the_last(spark):
    bars = B.synthetic(spark, "trending", 2600, 60)
    ts = [r["ts"] for r in bars.orderBy(F.desc("ts")).limit(40).collect()]
    judged = spark.createDataFrame([("trending", ts[0]), ("trending", ts[39])], "symbol string, ts timestamp_ntz")
    got = {r["ts"]: r for r in research.shadow_step(bars, judged=judged).collect()}
    assert set(got) == {ts[0], ts[39]}
    earlier = research.shadow_step(bars.filter(F.col("ts") <= F.lit(ts[39]))).first()
    assert [got[ts[39]][c] for c in ("side", "score", "price", "action")] == [earlier[c] for c in ("side", "score", "price", "action")]
