"""q26, q72 and the search's score against plain versions."""

from statistics import NormalDist

import numpy as np
import pytest

from quillon.plans import queries as plans
from quillon.plans import research

DATA = "/root/testdata/sf0.01"


def _weights(d, threshold=1e-5):
    w, k = [1.0], 1
    while abs(nxt := -w[-1] * (d - k + 1) / k) >= threshold and k < 10_000:
        w.append(nxt)
        k += 1
    return np.array(w[::-1])


def _dickey_fuller(x):
    change = np.diff(x)
    design = np.column_stack([np.ones(len(change) - 1), x[1:-1], change[:-1]])
    beta, *_ = np.linalg.lstsq(design, change[1:], rcond=None)
    rest = change[1:] - design @ beta
    covariance = np.linalg.inv(design.T @ design) * (rest @ rest) / (len(rest) - 3)
    return beta[1] / np.sqrt(covariance[1, 1])


def test_smallest_stationary_order(spark):
    bars = plans.daily(spark, DATA).toPandas().sort_values(["symbol", "ts"])
    got = {r.symbol: r for r in plans.q26_min_stationary_d(spark, DATA).collect()}
    assert set(got) == set(bars["symbol"])
    for s, g in bars.groupby("symbol"):
        close, want = g["close"].to_numpy(float), (1.0, None)
        for d in (i / 10 for i in range(11)):
            w = _weights(d)
            x = np.array([close[i - len(w) + 1 : i + 1] @ w for i in range(len(w) - 1, len(close))])
            # the 5 % value of the test with a constant in long samples
            if len(x) >= 100 and (t := _dickey_fuller(x)) < -2.861:
                want = (d, t)
                break
        assert got[s].d == want[0]
        assert (got[s].statistic is None or np.isnan(got[s].statistic)) if want[1] is None else got[s].statistic == pytest.approx(want[1], rel=1e-4)


def test_probabilities_of_the_sharpe_ratio(spark):
    bars = plans.vwap(spark, DATA).toPandas().sort_values(["symbol", "ts"])
    got = {r.symbol: r for r in plans.q72_psr_dsr(spark, DATA).collect()}
    assert set(got) == set(bars["symbol"])
    z, euler, n_trials, variance = NormalDist(), 0.5772156649015329, 20, 0.01
    best = np.sqrt(variance) * ((1 - euler) * z.inv_cdf(1 - 1 / n_trials) + euler * z.inv_cdf(1 - 1 / (n_trials * np.e)))
    for s, g in bars.groupby("symbol"):
        x = np.diff(np.log(g["close"].to_numpy(float)))
        sr, dev = x.mean() / x.std(ddof=1), (x - x.mean()) / x.std()
        spread = np.sqrt(1 - (dev**3).mean() * sr + ((dev**4).mean() - 1) / 4 * sr**2)
        of = lambda b, sr=sr, spread=spread, n=len(x): z.cdf((sr - b) * np.sqrt(n - 1) / spread)
        assert (got[s].sr, got[s].psr, got[s].dsr) == (pytest.approx(sr, rel=1e-6), pytest.approx(of(0.0), abs=1e-6), pytest.approx(of(best), abs=1e-6))


@pytest.mark.parametrize(
    ("rows", "complete", "events", "folds", "want"),
    [
        (1000, 600, 60, [], -10.0),  # fewer bars than the gate and the weights need
        (4000, 499, 60, [], -10.0),
        (4000, 600, 49, [], -5.0),
        (4000, 600, 60, [(19, 9, 1.0), (30, 4, 1.0), (30, 9, None)], -3.0),
        (4000, 600, 60, [(20, 5, 1.0), (30, 9, 2.0), (19, 9, 50.0), (30, 4, 50.0), (30, 9, None)], 1.25),
    ],
)
def test_gates_and_score_of_the_search(spark, monkeypatch, rows, complete, events, folds, want):
    """The folds stand in for a backtest's: ratios 1 and 2 pass, with mean 1.5 and deviation 0.5."""
    series = lambda n: spark.range(n).selectExpr("'x' AS symbol", "timestamp_seconds(id) AS ts", "1.0D AS close")
    monkeypatch.setattr(research, "signal_table", lambda bars, settings: series(complete))
    monkeypatch.setattr(research.labels, "cusum_events", lambda table: series(events).select("symbol", "ts"))
    schema = "combo_id int, n_events long, n_trades long, sharpe double"
    scores = spark.createDataFrame([(i, *f) for i, f in enumerate(folds)], schema)
    monkeypatch.setattr(research, "fold_scores", lambda *args: scores)
    got = research.objective(series(rows), {})
    assert got["value"] == pytest.approx(want, abs=1e-6) and got["n_folds"] == (2 if want > 0 else 0)
