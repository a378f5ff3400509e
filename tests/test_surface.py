"""Tables of progress, numbers and settings as they are shown, and the dispatcher's exit codes."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quillon import cli, storage
from quillon.functions import display
from quillon.streaming import live, progress


def test_progress_of_batches_becomes_a_table(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    listener = progress.log_progress(spark, log, every=1)
    try:
        for i in range(2):
            spark.range(i * 10, i * 10 + 10).select("id", F.timestamp_seconds("id").alias("ts")).write.mode("append").parquet(source)
            stream = spark.readStream.schema("id long, ts timestamp").parquet(source)
            counted = stream.withWatermark("ts", "1 second").dropDuplicatesWithinWatermark(["id"])
            live.append_to(counted, out, str(tmp_path / "c"), once=True).awaitTermination()
        for _ in range(60):
            time.sleep(0.5)
            listener.flush()
            try:
                rows = spark.read.parquet(log).collect()
            except Exception:  # noqa: BLE001  nothing is written yet
                continue
            if sum(r["event"] == "terminated" for r in rows) == 2:
                break
    finally:
        spark.streams.removeListener(listener)
    batches = {r["batch"]: r for r in rows if r["event"] == "progress" and r["input_rows"]}
    assert {b: r["input_rows"] for b, r in batches.items()} == {0: 10, min(b for b in batches if b): 10}
    assert all(r["duration_ms"] > 0 and r["state_rows"] is not None for r in batches.values()), batches
    assert sum(r["event"] == "started" for r in rows) == 2


def test_numbers_and_secrets(spark):
    df = spark.createDataFrame([(1.23456789, float("nan"), 1, "k"), (float("-inf"), 0.0000005, None, None), (None, 2.5e-7, 3, "x")], "`a.b` double, b float, c int, d string")
    got = [tuple(r) for r in display.for_json(df).collect()]
    assert got[0] == (1.234568, None, 1, "k") and got[1][0] is None and got[2][0] is None and got[2][1] == 0.0
    rows = [("web_password", "abcdefgh"), ("WEB_PASSWORD", "abcdef"), ("WEB_PASSWORD", ""), ("LOG_LEVEL", "INFO"), ("WEB_PASSWORD", None)]
    shown = spark.createDataFrame(rows, "k string, v string").select(display.masked(F.col("k"), F.col("v"))).collect()
    assert [r[0] for r in shown] == ["ab…****gh", "******", "", "INFO", None]


def test_stages_are_removed_on_release(spark):
    with storage.temporary(spark):
        path = storage.stage(spark.range(3)).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
        with storage.temporary(spark):
            inner = storage.stage(spark.range(3)).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and not os.path.exists(inner)
        storage.release(spark)
        assert not os.path.exists(path)


def test_dispatcher_exit_codes(monkeypatch, tmp_path):
    ran = []
    monkeypatch.setattr(cli, "session", lambda *a, **k: None)

    def command(result):
        def run(spark, args):
            ran.append((args.bars, args.out))
            if isinstance(result, BaseException):
                raise result

        return run

    env = {"RUN_MODE": " Backtest ", "QUILLON_BARS": "b", "QUILLON_OUT": "o"}
    for result, code in ((None, 0), (ValueError("x"), 1), (KeyboardInterrupt(), 130)):
        monkeypatch.setitem(cli.COMMANDS, "backtest", command(result))
        assert cli.dispatch(env) == code
    assert ran == [("b", "o")] * 3
    assert cli.dispatch({"RUN_MODE": "dance"}) == 2 and cli.dispatch({}) == 2


def test_commands_end_to_end(spark, tmp_path, monkeypatch):
    """fetch, backtest with tuned parameters and the best of a search, on files."""
    monkeypatch.setattr(cli, "session", lambda *a, **k: spark)
    at = lambda n: str(tmp_path / n)
    ticks = spark.range(3000).select(F.lit("X").alias("symbol"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).alias("ts"), (100 + F.sin(F.col("id") / 30)).alias("price"), F.lit(1.0).alias("volume"), (100 + F.sin(F.col("id") / 30)).alias("turnover"), F.col("id").alias("tie"))
    ticks.write.parquet(at("ticks"))
    for _ in range(2):  # the second time adds nothing
        cli.main(["fetch", "--ticks", at("ticks"), "--bars", at("bars"), "--interval", "5"])
    assert spark.read.parquet(at("bars")).count() == 600
    (tmp_path / "p.json").write_text(json.dumps({"best_params": {"frac_d": 0.8, "min_abs_score": 0.1}}))
    seen = []
    plan = cli.research.backtest_plan
    monkeypatch.setattr(cli.research, "backtest_plan", lambda *a: seen.append(a) or plan(*a))
    cli.main(["backtest", "--bars", at("bars"), "--params", at("p.json"), "--out", at("out")])
    assert (seen[0][1].features.frac_d, seen[0][1].primary.min_abs_score) == (0.8, 0.1)
    assert spark.read.csv(at("out/equity"), header=True).columns == ["symbol", "ts", "equity", "ret"]
    assert "entry_time" in spark.read.csv(at("out/trades"), header=True).columns or spark.read.text(at("out/trades")).count() == 0
    monkeypatch.setattr(cli.research, "objective", lambda bars, point, **k: {"value": -point["frac_d"], "n_folds": 1})
    cli.main(["optimize", "--bars", at("bars"), "--trials", "12", "--out", at("opt")])
    best = spark.read.json(at("opt/best")).collect()
    assert len(best) == 5 and max(r["value"] for r in best) >= -0.5


@pytest.mark.parametrize("name", ["q86_rollup_report"])
def test_rollup_has_every_level(spark, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert {r["level"] for r in got} == {0, 1, 3}
    assert sum(r["cells"] for r in got if r["level"] == 0) == sum(r["cells"] for r in got if r["level"] == 3)
