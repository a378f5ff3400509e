"""The Parzen sampler: densities against plain sums, and a search that gets better."""

import math

import numpy as np
import pytest

from quillon.operators import tpe
from quillon.plans import research

SPACE = (tpe.Range("x", 0.0, 10.0), tpe.Range("k", 1, 4))
TRIALS = "trial int, value double, x double, k double"


def plain_log_density(trials, weights, point):
    h = tpe.width(len(trials), len(SPACE))
    total = 1.0
    for t, w in zip(trials, weights, strict=True):
        mass = w
        for p in SPACE:
            a, c = p.unit(t[p.name]), p.unit(point[p.name])
            mass *= sum(math.exp(-((d / h) ** 2) / 2) for d in (c - a, c + a, 2 - c - a)) / (h * math.sqrt(2 * math.pi))
        total += mass
    return math.log(total / (1 + sum(weights)))


def test_densities_are_the_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i == 5 else float("nan") if i == 6 else float(rng.integers(0, 9)), float(rng.uniform(0, 10)), float(rng.integers(1, 5))) for i in range(60)]
    trials = [dict(zip(("trial", "value", "x", "k"), r, strict=True)) for r in rows if r[1] is not None and r[1] == r[1]]
    best = sorted(trials, key=lambda t: (-t["value"], t["trial"]))[: math.ceil(0.1 * len(trials))]
    rest = [t for t in trials if t not in best]
    points = [{"x": 0.0, "k": 1}, {"x": 9.5, "k": 4}, {"x": 5.0, "k": 2}]
    got = {r["candidate"]: r for r in tpe.densities(spark.createDataFrame(rows, TRIALS), SPACE, points).collect()}
    for i, p in enumerate(points):
        good = plain_log_density(best, [1.0] * len(best), p)
        other = plain_log_density(rest, [min(1.0, (t["trial"] + 1) / 35) for t in rest], p)
        assert (got[i]["log_good"], got[i]["log_rest"], got[i]["score"]) == pytest.approx((good, other, good - other), abs=1e-9)


def test_kernels_have_mass_one_and_values_stay_in_range():
    h, at = 0.2, 0.05
    u = (np.arange(20_000) + 0.5) / 20_000
    mass = sum(np.exp(-(((u * s + o) - at) ** 2) / (2 * h * h)) for s, o in ((1, 0), (-1, 0), (-1, 2))).mean() / (h * math.sqrt(2 * math.pi))
    assert mass == pytest.approx(1, abs=1e-6)
    rng = np.random.default_rng(1)
    points = [tpe.near([{"x": 9.9, "k": 1}], SPACE, rng) for _ in range(500)]
    assert all(0 <= p["x"] <= 10 and p["k"] in (1, 2, 3, 4) and isinstance(p["k"], int) for p in points)
    assert np.mean([p["x"] > 5 for p in points]) > 0.6


def test_proposals_beat_random_points(spark):
    score = lambda p: -((p["x"] - 7.3) ** 2) - (p["k"] != 3)
    points, rows = [], []
    for turn in range(8):
        trials = spark.createDataFrame(rows, TRIALS) if rows else None
        new = tpe.propose(trials, SPACE, 11 + turn, 6)
        assert new == tpe.propose(trials, SPACE, 11 + turn, 6)  # by the seed alone
        points += new
        rows = [(i, score(p), float(p["x"]), float(p["k"])) for i, p in enumerate(points)]
    late, early = (np.mean([score(p) for p in part]) for part in (points[-12:], points[:12]))
    assert late > early + 3 and max(map(score, points)) > -0.2


def test_no_trials_with_values(spark):
    none = spark.createDataFrame([(0, None, 1.0, 1.0)], TRIALS)
    assert len(tpe.propose(none, SPACE, 1, 3)) == 3
    with pytest.raises(ValueError):
        tpe.densities(none, SPACE, [{"x": 1.0, "k": 1}])


@pytest.mark.parametrize("sampler", ["tpe", "random"])
def test_search_keeps_its_trials_in_order(spark, monkeypatch, sampler):
    monkeypatch.setattr(research, "objective", lambda bars, point: {"value": -abs(point["frac_d"] - 0.5), "mean_sharpe": 1.0, "n_folds": 2})
    got = research.search(spark, None, 22, sampler=sampler).orderBy("trial").collect()
    assert [r["trial"] for r in got] == list(range(22)) and all(f'"frac_d": {0.5 - abs(r["value"])}'[:17] in r["params"] or f'"frac_d": {0.5 + abs(r["value"])}'[:17] in r["params"] for r in got)
    assert research.best_trials(spark.createDataFrame(got, research.TRIALS), 22).first()["value"] == max(r["value"] for r in got)
