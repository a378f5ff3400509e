"""Registered queries over every row, against brute force and DuckDB."""

from functools import cache

import numpy as np
import pandas as pd
import pytest
from test_operators import walk_trade

import __spark_entry__ as entry
from quillon.params import BacktestConfig
from quillon.plans import queries as plans

DATA = "/root/testdata/sf0.001"
WHOLE = ("q25", "q43", "q44", "q50", "q53", "q54", "q55", "q58", "q59", "q60", "q67")
SMALL = ("symbol", "other", "ts", "entry_time", "e", "mode", "y")


@pytest.fixture(scope="module")
def run(spark):
    return cache(lambda name: entry.queries()[name](spark, DATA).toPandas())


@pytest.fixture(scope="module")
def bars(spark):
    pdf = plans.vwap(spark, DATA).toPandas().sort_values(["symbol", "ts"])
    return {s: g.reset_index(drop=True) for s, g in pdf.groupby("symbol")}


def test_every_bar_is_labelled(run, bars):
    got = {(r.symbol, r.ts): r for r in run("q43_triple_barrier").itertuples()}
    n = 0
    for s, g in bars.items():
        c = g["close"].to_numpy()
        target = (g["close"].rolling(20).std() / g["close"].rolling(20).mean()).to_numpy()
        for i in range(19, len(c) - 1):
            tv = max(target[i], 5e-4)
            path = c[i : i + 49] / c[i] - 1
            hits = [(j, 1 if x >= 2 * tv else -1) for j, x in enumerate(path) if x >= 2 * tv or x <= -tv]
            j, bin_ = hits[0] if hits else (len(path) - 1, 0)
            r = got[s, g["ts"][i]]
            assert (r.bin, r.t1) == (bin_, g["ts"][i + j]) and r.ret == pytest.approx(path[j], abs=1e-6)
            n += 1
    assert n == len(got) == run("q44_meta_target")["n"].sum()


def test_every_bar_with_a_side_is_a_candidate_in_all_modes(run, bars):
    plan = run("q54_cost_adjusted_rr_gate")
    got = {(r.symbol, r.e): r for r in run("q55_barrier_resolution_trailing").itertuples()}
    cfg = BacktestConfig(bars_per_year=252)
    assert set(plan["mode"]) == {0, 1, 2} == set(run("q53_profit_factor_by_mode")["mode"]) and len(plan) == len(got)
    assert set(zip(plan["mode"], plan["hold"], strict=True)) == {(0, 48), (1, 72), (2, 24)}
    by_key = {(r.symbol, r.e): r for r in plan.itertuples()}
    n = 0
    for s, g in bars.items():
        c = g["close"].to_numpy()
        side = np.sign(g["close"] - g["close"].rolling(20).mean()).fillna(0).to_numpy()
        atr = np.maximum((g["high"] - g["low"]) / g["close"] / 40, 1e-4).to_numpy()
        rt = cfg.round_trip
        for e in range(len(c) - 2):
            m = e % 3
            pt, sl = ((2, 1), (3, 1.5), (1.5, 1))[m][0] * atr[e], ((2, 1), (3, 1.5), (1.5, 1))[m][1] * atr[e]
            if pt - rt <= 0 or (pt - rt) / (sl + rt) < 1.3:
                pt = 1.3 * (sl + rt) + rt
                if pt / atr[e] > 6:
                    assert (s, e) not in by_key
                    continue
            if not side[e]:
                continue
            scale = max(0.003 / pt, 1)
            p, r = by_key[s, e], got[s, e]
            assert (p.mode, p.pt_frac) == (m, pytest.approx(pt * scale, abs=1e-7))
            want = walk_trade(c, e, int(side[e]), pt * scale, sl * scale, p.hold, atr[e], 2.0 if m == 1 else None)
            assert (r.exit_n, r.barrier) == (want[0], want[2]) and r.gross_ret == pytest.approx(want[1], abs=1e-7)
            n += 1
    assert n == len(plan)


def test_every_bar_starts_a_path(run, bars):
    assert len(run("q67_band_join_paths")) == sum(map(len, bars.values()))


def test_meta_rows_and_entry_take_every_bar(spark, run):
    labelled = plans.labels.triple_barrier(plans.vwap(spark, DATA), plans._label_events(plans.vwap(spark, DATA))).select("symbol", "ts")
    assert entry.entry(spark).agg({"n": "sum"}).first()[0] == labelled.count() == len(run("q43_triple_barrier"))
    rows = plans._meta_rows(spark, DATA)
    assert rows.count() == plans._signal_inputs(spark, DATA).join(labelled, ["symbol", "ts"]).count()


def test_bootstrap_draws_from_all_trades(spark, run, monkeypatch):
    seen = []
    own = plans.validation.bootstrap
    monkeypatch.setattr(plans.validation, "bootstrap", lambda trades, *more: seen.append(trades) or own(trades, 2))
    plans.q73_mc_bootstrap(spark, DATA)
    assert seen[0].count() == len(run("q58_single_position_trades"))


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith(WHOLE)])
def test_whole_queries_match_their_oracles(run, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    want, got = con.execute(entry.oracle_sql()[name]).df(), run(name)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    keys = [c for c in SMALL if c in order]
    a, b = (x[order].sort_values(keys, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-6, atol=1e-6)


def test_queries_call_their_operators_with_production_defaults(spark, monkeypatch):
    calls = {}
    note = lambda name: lambda *args, **kw: calls.setdefault(name, (args, kw))
    own = plans.validation.bootstrap
    monkeypatch.setattr(plans.validation, "bootstrap", lambda *args, **kw: note("bootstrap")(*args, **kw) and own(args[0], 2))
    monkeypatch.setattr(plans.research, "search", note("search"))
    monkeypatch.setattr(plans.features, "min_stationary_d", note("grid"))
    monkeypatch.setattr(plans.meta, "fit", note("fit"))
    plans.q73_mc_bootstrap(spark, DATA)
    plans.q74_parameter_search(spark, DATA)
    plans.q26_min_stationary_d(spark, DATA)
    plans._meta_fit(None)
    assert len(calls["bootstrap"][0]) == 1 and not calls["bootstrap"][1]  # 2000 simulations
    assert calls["search"][0][2:] == (plans.SEARCH_TRIALS,) and not calls["search"][1]  # the operator's gates
    assert len(calls["grid"][0]) == 1 and not calls["grid"][1]  # eleven values of d
    p = calls["fit"][0][2]
    assert (p.n_estimators, p.max_depth) == (400, plans.MetaParams().max_depth)


def test_synthetic_bars_have_every_cell(spark):
    got = plans.q06_synthetic_bars(spark, DATA).groupBy("symbol").count().toPandas().set_index("symbol")["count"]
    assert len(got) == 60 and got.sum() == 585_000 and got["major/5/11"] == 18_000 and got["trending/240/47"] == 3_000


def test_frac_diff_at_the_own_threshold_has_values(spark):
    # the smallest tables have fewer bars than there are weights
    larger = DATA.replace("sf0.001", "sf0.01")
    got = entry.queries()["q25_frac_diff_all"](spark, larger).toPandas().sort_values(["symbol", "ts"])
    bars = plans.daily(spark, larger).toPandas().sort_values(["symbol", "ts"])
    w = plans.features.R.ffd_weights(0.4, 1e-5)
    for s, g in bars.groupby("symbol"):
        ffd = got.loc[got["symbol"] == s, "ffd"].to_numpy(float)
        want = [g["close"].to_numpy()[i - len(w) + 1 : i + 1] @ w for i in range(len(w) - 1, len(g))]
        assert np.isnan(ffd[: len(w) - 1]).all() and len(want) > 0
        np.testing.assert_allclose(ffd[len(w) - 1 :], want, atol=1e-4)


def test_rounds_before_the_first_densities_do_not_wait(spark, monkeypatch):
    import threading

    points = [p for first, n in ((0, 6), (6, 2)) for p in plans.tpe.propose(None, [plans.tpe.Range(*r) for r in plans.research.SPACE], 42 + first, n)]
    last = threading.Event()

    def objective(bars, point):
        if point == points[7]:
            last.set()
        waited = last.wait(20) if point == points[0] else True
        return {"value": float(points.index(point)) if waited else -1.0, "n_folds": 0}

    monkeypatch.setattr(plans.research, "objective", objective)
    got = plans.research.search(spark, None, 8).orderBy("trial").collect()
    assert [r["value"] for r in got] == [float(i) for i in range(8)]  # the same points in the same order


def test_search_keeps_the_order_of_trials(spark, monkeypatch):
    monkeypatch.setattr(plans.research, "objective", lambda bars, point: {"value": point["frac_d"], "n_folds": 0})
    got = plans.research.search(spark, None, 20, sampler="random").orderBy("trial").collect()
    assert [r["value"] for r in got] == [p["frac_d"] for p in plans.research.draw(20)]


def test_every_pair_of_symbols_is_aligned(run, bars):
    got = run("q60_aligned_returns_join")
    pairs = [(a, b) for a in bars for b in bars if a < b]
    assert len(pairs) == 3 and len(got) == sum(len(set(bars[a]["ts"]) & set(bars[b]["ts"])) for a, b in pairs)
    assert set(zip(got["symbol"], got["other"], strict=True)) == set(pairs)
