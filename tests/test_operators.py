"""Operators on small tables with known results."""

import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import windows as W
from quillon.operators import backtest, features, labels, meta, risk, signals, validation
from quillon.params import BacktestConfig, FeatureParams, MetaParams, PrimaryParams, RiskLimits, apply_overrides, interval
from quillon.plans import research
from quillon.sources import bars as B

T0 = dt.datetime(2024, 1, 1)


def series(spark, closes, symbol="X", minutes=5):
    rows = [(symbol, T0 + dt.timedelta(minutes=minutes * i), c, c * 1.001, c * 0.999, c, 1.0, c) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, B.BARS)


def walk(n=600, seed=7):
    return 100 * np.exp(np.random.default_rng(seed).normal(0, 0.01, n).cumsum())


def test_interval():
    assert interval("5") == "5 minutes"
    with pytest.raises(ValueError):
        interval("7")


def test_time_bars_and_bad_ticks(spark):
    rows = [("X", T0, 10.0, 1.0, 10.0, 1), ("X", T0, 12.0, 2.0, 24.0, 2), ("X", T0, -1.0, 1.0, 1.0, 3), ("X", T0 + dt.timedelta(minutes=5), 9.0, 1.0, 9.0, 4)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, price double, volume double, turnover double, tie int")
    got = B.time_bars(ticks, "5 minutes").orderBy("ts").collect()
    assert [tuple(r)[2:] for r in got] == [(10.0, 12.0, 10.0, 12.0, 3.0, 34.0), (9.0, 9.0, 9.0, 9.0, 1.0, 9.0)]


def test_merge_prefers_new_rows_and_append_adds_only_missing(spark, tmp_path):
    old, new = series(spark, [1, 2, 3]), series(spark, [9, 9])
    assert sorted(r["close"] for r in B.merge_bars(old, new).collect()) == [3.0, 9.0, 9.0]
    path = str(tmp_path / "cache")
    B.append_bars(old, path)
    B.append_bars(series(spark, [7, 7, 7, 4]), path)
    assert sorted(r["close"] for r in B.read_bars(spark, path).collect()) == [1.0, 2.0, 3.0, 4.0]


def test_parse_pages(spark):
    page = '{"retCode":0,"result":{"list":[["1704067500000","2","3","1","2.5","10","25"],["1704067200000","1","2","1","2","5","10"]]}}'
    got = B.parse_pages(spark.createDataFrame([("X", page)], "symbol string, page string")).orderBy("ts").collect()
    assert [r["close"] for r in got] == [2.0, 2.5] and got[0]["ts"] == T0
    bad = spark.createDataFrame([("X", '{"retCode":10,"result":null}')], "symbol string, page string")
    with pytest.raises(Exception, match="retCode"):
        B.parse_pages(bad).collect()


def test_pct_rank_and_full_rank_match_pandas(spark):
    x = np.random.default_rng(1).integers(0, 30, 300)
    df = series(spark, x + 1).withColumn("x", F.col("close"))
    got = df.select("ts", W.pct_rank(F.col("x"), 50, 10).alias("a"), W.full_pct_rank(F.col("x")).alias("b")).orderBy("ts").toPandas()
    s = pd.Series(x + 1.0)
    np.testing.assert_allclose(got["a"].to_numpy(float), s.rolling(50, min_periods=10).rank(pct=True))
    np.testing.assert_allclose(got["b"], s.rank(pct=True))


def test_nothing_looks_ahead_but_pivots_and_regime(spark):
    closes = walk(520)
    p = FeatureParams(frac_d=0.8)
    full = features.feature_matrix(series(spark, closes), p).filter(F.col("ts") < T0 + dt.timedelta(minutes=5 * 400)).toPandas().sort_values("ts")
    cut = features.feature_matrix(series(spark, closes[:400]), p).toPandas().sort_values("ts")
    skip = {"symbol", "ts", "regime", *(c for c in features.MATRIX if c.startswith(("fib", "ew")))}
    for c in set(features.MATRIX) - skip:
        np.testing.assert_allclose(full[c].to_numpy(float), cut[c].to_numpy(float), rtol=1e-9, atol=1e-12, err_msg=c)


def test_symbols_are_independent(spark):
    a, b = series(spark, walk(300)), series(spark, walk(300, 8), "Y")
    alone = features.add_rsi(features.add_atr(a)).toPandas().sort_values("ts")
    both = features.add_rsi(features.add_atr(a.unionByName(b))).filter("symbol = 'X'").toPandas().sort_values("ts")
    np.testing.assert_allclose(alone["rsi_14"].to_numpy(float), both["rsi_14"].to_numpy(float))


def test_elliott_and_fibonacci_are_neutral_without_pivots(spark):
    bars = features.add_atr(series(spark, walk(60)))
    none = spark.createDataFrame([], features.PIVOTS)
    got = features.add_elliott(features.add_fibonacci(bars, none), none).select("fib_nearest_dist_atr", "ew_wave_id", "ew_confidence").distinct().collect()
    assert [tuple(r) for r in got] == [(999.0, 0, 0.0)]


def label(spark, closes, **kw):
    bars = series(spark, closes)
    events = bars.limit(0).select("symbol", "ts", F.lit(0.01).alias("target_vol")).unionByName(bars.orderBy("ts").limit(1).select("symbol", "ts", F.lit(0.01).alias("target_vol")))
    if "side" in kw:
        events = events.withColumn("side", F.lit(kw.pop("side")))
    return labels.triple_barrier(bars, events, **kw).collect()


def test_triple_barrier_paths(spark):
    assert [(r["bin"], round(r["ret"], 4)) for r in label(spark, [100, 101, 103, 90])] == [(1.0, 0.03)]
    assert [r["bin"] for r in label(spark, [100, 98.5, 110])] == [-1.0]
    assert [(r["bin"], r["t1"]) for r in label(spark, [100, 100.1, 100.2, 100.3], hold=2)] == [(0.0, T0 + dt.timedelta(minutes=10))]
    assert label(spark, [100]) == []
    assert [r["bin"] for r in label(spark, [100, 97, 90], side=-1.0)] == [1.0]


def test_dollar_bars(spark):
    bars = series(spark, [5, 5, 12, 3, 8, 1])
    got = labels.dollar_bars(bars, spark.createDataFrame([("X", 10.0)], "symbol string, threshold double")).orderBy("ts").collect()
    assert [(r["open"], r["close"], r["turnover"]) for r in got] == [(5.0, 5.0, 10.0), (12.0, 12.0, 12.0), (3.0, 8.0, 11.0)]


def test_daily_volatility_matches_pandas(spark):
    closes = walk(900)
    got = labels.daily_volatility(series(spark, closes)).orderBy("ts").toPandas()["target_vol"].to_numpy(float)
    ret = pd.Series(closes[289:] / closes[:-289] - 1)
    want = ret.ewm(span=100, min_periods=20).std().to_numpy()
    np.testing.assert_allclose(got[289:], want)
    assert np.isnan(got[:289]).all()


def test_cooldown(spark):
    rows = [("X", T0 + dt.timedelta(minutes=i), 1.0, 100.0, 99.9, 99.0, 0.01, 1.0, 30.0, 20.0, 30.0, 50.0, 1.0, 1.0, 0.0) for i in range(8)]
    cols = "symbol string, ts timestamp_ntz, is_trend_up double, close double, ema20 double, ema50 double, atr_pct double, trend_align double, plus_di double, minus_di double, adx double, rsi double, macd_hist_slope double, macd_hist_z double, is_chop double"
    got = signals.primary_signals(spark.createDataFrame(rows, cols), PrimaryParams(cooldown_bars=2)).orderBy("ts").collect()
    assert [r["primary_side"] for r in got] == [1, 0, 0, 1, 0, 0, 1, 0]
    assert got[0]["primary_score"] == pytest.approx(0.55 + 0.2 * math.tanh(1 / 1.5))


def test_sizing(spark):
    one = spark.range(1).select(
        signals.fractional_kelly(F.lit(0.6), F.lit(2.0)).alias("k"),
        signals.vol_target_size(F.lit(1000.0), F.lit(10.0), F.lit(0.3)).alias("v"),
        signals.vol_target_size(F.lit(1000.0), F.lit(10.0), F.lit(0.0)).alias("z"),
        signals.combined_size(F.lit(1000.0), F.lit(10.0), F.lit(0.3), F.lit(0.5), F.lit(2.0)).alias("c"),
    ).first()
    assert one["k"] == pytest.approx(0.1) and one["v"] == pytest.approx(50.0) and one["z"] == 0.0 and one["c"] == 0.0


def walk_trade(close, e, side, pt, sl, hold, atr, trail):
    """A plain walk along the path."""
    peak, last = 0.0, min(e + hold, len(close) - 1)
    for j in range(e + 1, last + 1):
        ret = side * (close[j] / close[e] - 1)
        peak = max(peak, ret)
        if ret >= pt:
            return j, pt, 1
        if ret <= -sl:
            return j, -sl, -1
        level = peak - trail * atr if trail is not None else None
        if trail is not None and peak > 0.8 * atr and ret <= level and level > 0:
            return j, ret, 1
    return last, side * (close[last] / close[e] - 1), 0


def test_barriers_match_a_plain_walk(spark):
    close = walk(400)
    cfg = BacktestConfig(trend_trail_atr=0.7)
    bars = series(spark, close).withColumn("n", W.row_no())
    rows = [("X", e, 1 if e % 2 else -1, 1 + e % 2, 0.01 + 0.002 * (e % 5)) for e in range(0, 395, 5)]
    plan = backtest.barrier_plan(spark.createDataFrame(rows, "symbol string, e int, side int, mode int, atr_frac double"), cfg).cache()
    got = {r["e"]: r for r in backtest.resolve_barriers(plan, bars.select("symbol", "n", "close"), cfg).collect()}
    for p in plan.collect():
        want = walk_trade(close, p["e"], p["side"], p["pt_frac"], p["sl_frac"], p["hold"], p["atr_frac"], p["trail"])
        r = got[p["e"]]
        assert (r["exit_n"], r["barrier"]) == (want[0], want[2]) and r["gross_ret"] == pytest.approx(want[1])


def test_cost_gate(spark):
    rows = [("X", i, 1, 1, a) for i, a in enumerate([0.01, 0.0012, 0.0003])]
    got = backtest.barrier_plan(spark.createDataFrame(rows, "symbol string, e int, side int, mode int, atr_frac double"), BacktestConfig()).orderBy("e").collect()
    assert [r["e"] for r in got] == [0, 1]  # the last would need more than 6 ATR
    assert got[0]["pt_frac"] == pytest.approx(0.03) and got[1]["pt_frac"] == pytest.approx(1.3 * (1.5 * 0.0012 + 0.0017) + 0.0017)


def test_backtest_end_to_end(spark):
    close = walk(500)
    bars = series(spark, close)
    events = bars.filter(F.minute("ts") % 20 == 0).select("symbol", "ts")
    sides = bars.select("symbol", "ts", F.lit(1).alias("side"), F.lit(1).alias("mode"))
    atr = bars.select("symbol", "ts", F.lit(0.01).alias("atr_frac"))
    out = backtest.run_backtest(bars, events, sides, BacktestConfig(), atr=atr)
    trades = out["trades"].orderBy("e").toPandas()
    assert len(trades) and (trades["e"].to_numpy()[1:] > trades["exit_n"].to_numpy()[:-1]).all()
    equity = 10_000.0
    for t in trades.itertuples():
        equity *= 1 + t.size_frac * t.net_ret
        assert t.equity_after == pytest.approx(equity)
    curve = out["equity"].orderBy("ts").toPandas()
    assert len(curve) == 500 and curve["equity"].iloc[-1] == pytest.approx(equity) and curve["equity"].iloc[0] == pytest.approx(trades["equity_after"].iloc[0])
    later = backtest.equity_curve(out["trades"], bars.withColumn("n", W.row_no()).select("symbol", "n", "ts"), BacktestConfig(equity_stamp="exit")).orderBy("ts").first()
    assert later["equity"] == 10_000.0
    assert out["stats"].first()["n_trades"] == len(trades)
    none = backtest.run_backtest(bars, events.limit(0), sides, BacktestConfig(), atr=atr)
    assert none["trades"].count() == 0 and none["stats"].count() == 0


def test_meta_guards_and_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    rows = [(float(a), float(b), int(a + 0.2 * rng.normal() > 0)) for a, b in x]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    model = meta.fit(df, ["a", "b"], MetaParams(n_estimators=40))
    scored = model.probabilities(df)
    assert scored.filter("y = 1").agg(F.avg("prob")).first()[0] > scored.filter("y = 0").agg(F.avg("prob")).first()[0] + 0.3
    model.save(str(tmp_path / "m"))
    assert meta.MetaModel.load(str(tmp_path / "m")).features == ("a", "b")
    with pytest.raises(KeyError):
        model.probabilities(df.drop("b"))
    with pytest.raises(ValueError, match="no training rows"):
        meta.fit(df.limit(0), ["a", "b"])
    with pytest.raises(ValueError, match="both kinds"):
        meta.fit(df.filter("y = 1"), ["a", "b"])


def test_cpcv_roles_match_a_plain_version(spark):
    n, gap = 97, 7
    bars = series(spark, walk(n)).select("symbol", "ts", W.row_no().alias("row_no"), F.lead("ts", gap).over(W.by_time()).alias("event_end"))
    got = {}
    for r in validation.cpcv_roles(bars).collect():
        got.setdefault((r["combo_id"], r["role"]), set()).add(r["row_no"])
    size, embargo = n // 6, 1
    bounds = [(k * size, (k + 1) * size if k < 5 else n) for k in range(6)]
    combo = 0
    for i in range(6):
        for j in range(i + 1, 6):
            test = {x for k in (i, j) for x in range(*bounds[k])}
            train = set(range(n)) - test
            for k in (i, j):
                s, e = bounds[k]
                train -= {x for x in range(n) if x + gap < n and x + gap >= s and x <= e - 1}
                train -= set(range(e, min(e + embargo, n)))
            assert got[combo, "test"] == test and got[combo, "train"] == train
            combo += 1


def test_overfitting_probability_limits(spark):
    rng = np.random.default_rng(1)
    good = [(t, s, float(rng.normal(0.5 if s == "a" else 0.0, 0.1))) for t in range(80) for s in "abcd"]
    assert validation.overfitting_probability(spark.createDataFrame(good, "t bigint, strategy string, ret double")).first()["pbo"] == 0.0
    few = spark.createDataFrame(good[:8], "t bigint, strategy string, ret double")
    assert validation.overfitting_probability(few).first()["pbo"] == 0.5


def test_sharpe_probabilities():
    assert validation.probabilistic_sharpe(0.0, 100, 0.0, 3.0) == pytest.approx(0.5)
    assert validation.probabilistic_sharpe(0.1, 1, 0.0, 3.0) == 0.0
    one = validation.deflated_sharpe(0.1, 100, 0.0, 3.0, 1, 0.01)
    assert one == 1.0
    assert validation.deflated_sharpe(0.1, 100, 0.0, 3.0, 50, 0.01) < validation.probabilistic_sharpe(0.1, 100, 0.0, 3.0)


def test_bootstrap_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(1).normal(0.001, 0.01, 60)
    trades = spark.createDataFrame([("AB"[i % 2], i, float(x)) for i, x in enumerate(r)], "symbol string, e bigint, net_ret double")
    a = validation.bootstrap(trades, 100).first()
    ordered = [float(x) for x in (*r[::2], *r[1::2])]
    finals, falls = [], []
    for sim in range(100):
        grown = np.cumprod([1 + ordered[int(hashlib.md5(f"42-{sim}-{pos}".encode()).hexdigest()[:8], 16) % 60] for pos in range(60)])
        finals.append(grown[-1] - 1)
        falls.append((grown / np.maximum.accumulate(grown) - 1).min())
    want = (np.mean(finals), *np.percentile(finals, [50, 5, 95]), np.percentile(falls, 5), np.mean(falls))
    assert tuple(a) == pytest.approx(want)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        assert tuple(validation.bootstrap(trades.repartition(7), 100).first()) == pytest.approx(tuple(a))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tuple(validation.bootstrap(trades.limit(0)).first()) == (0.0,) * 6
    lost = spark.createDataFrame([("A", 0, -1.5)], "symbol string, e bigint, net_ret double")
    assert tuple(validation.bootstrap(lost, 3, horizon=3).first())[:4] == pytest.approx((-0.125 - 1,) * 4)


def test_breakers_match_the_stepwise_state(spark):
    rng = np.random.default_rng(3)
    equity = 10_000 * np.exp(rng.normal(0, 0.012, 400).cumsum())
    bars = series(spark, equity, minutes=120).select("symbol", "ts", F.col("close").alias("equity"))
    lim = RiskLimits()
    got = risk.breakers(bars, lim).orderBy("ts").collect()
    state = risk.RiskState.start(float(equity[0]))
    for r in got:
        state = state.update(r["equity"], str(r["ts"].date()), lim)
        assert (r["halted"], r["size_multiplier"]) == (state.halted, state.size_multiplier), r["ts"]
    assert state.reset_halt().size_multiplier == 1.0 and state.opened("X", 1).closed("X", 5.0, "d", lim).positions == {}


def test_open_reasons(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 0.01, 200)
    rows = []
    for name, r in {"A": base, "B": base + rng.normal(0, 0.001, 200), "C": rng.normal(0, 0.2, 200), "D": rng.normal(0, 0.01, 200)}.items():
        rows += [(name, T0 + dt.timedelta(minutes=i), float(x)) for i, x in enumerate(r)]
    returns = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double")
    want = spark.createDataFrame([("A", 1), ("B", 1), ("B", -1), ("C", 1), ("D", 1)], "symbol string, side int")
    held = spark.createDataFrame([("A", 1)], "symbol string, side int")
    got = {(r["symbol"], r["side"]): r["reason"] for r in risk.open_reasons(want, held, returns).collect()}
    assert got == {("A", 1): "position already open", ("B", 1): "correlation cap vs A", ("B", -1): "ok", ("C", 1): "value at risk", ("D", 1): "ok"}


def test_drift(spark):
    rng = np.random.default_rng(2)
    ref = spark.createDataFrame([("X", float(x)) for x in rng.normal(0, 1, 800)] + [("Y", float(x)) for x in rng.normal(0, 1, 800)], "symbol string, x double")
    rows = [("X", T0 + dt.timedelta(minutes=i), float(x)) for i, x in enumerate(rng.normal(0, 1, 300))]
    rows += [("Y", T0 + dt.timedelta(minutes=i), float(x)) for i, x in enumerate(rng.normal(1, 1, 300))]
    got = {r["symbol"]: r for r in risk.drift(ref, spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")).collect()}
    assert got["Y"]["drift"] and not got["X"]["drift"] and got["Y"]["ks_p"] < 1e-6


def test_overrides_and_search_space():
    s = research.Settings().with_overrides({"adx_n": 12, "min_abs_score": 0.3, "range_pt_atr": 1.1, "unknown": 1})
    assert (s.features.adx_n, s.primary.min_abs_score, s.backtest.range_pt_atr) == (12, 0.3, 1.1)
    assert research.draw(3, 1) == research.draw(3, 1) and len(research.SPACE) == 34
    assert apply_overrides(FeatureParams(), {}) == FeatureParams()
