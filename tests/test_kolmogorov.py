"""Exact probabilities against counted paths, in batch and stream."""

from fractions import Fraction
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import kolmogorov, risk
from quillon.params import DriftConfig
from quillon.streaming import live


def counted(reach, n, m):
    """Share of all orders of the two samples whose distance is at least reach / (n m)."""
    hit = 0
    for own in combinations(range(n + m), n):
        i, most = 0, 0
        for s in range(n + m):
            i += s in own
            most = max(most, abs(i * m - (s + 1 - i) * n))
        hit += most >= reach
    return hit / comb(n + m, n)


def whole_numbers(reach, n, m):
    """Paths that stay inside, counted with whole numbers."""
    paths = [0] * (m + 1)
    for i in range(n + 1):
        for j in range(m + 1):
            if abs(i * m - j * n) >= reach:
                paths[j] = 0
            elif i == 0 and j == 0:
                paths[j] = 1
            else:
                paths[j] = (paths[j] if i else 0) + (paths[j - 1] if j else 0)
    return float(1 - Fraction(paths[m], comb(n + m, n)))


@pytest.mark.parametrize(("n", "m"), [(1, 1), (4, 4), (3, 7), (6, 5)])
def test_small_samples_against_all_orders(n, m):
    for reach in range(0, n * m + 1):
        assert kolmogorov.exact_p(reach, n, m) == pytest.approx(counted(reach, n, m), abs=1e-12)


@pytest.mark.parametrize(("n", "m"), [(50, 1000), (333, 700), (500, 1000)])
def test_large_samples_against_counted_paths(n, m):
    for d in (0.02, 0.08, 0.15, 0.4):
        reach = round(d * n * m)
        assert kolmogorov.exact_p(reach, n, m) == pytest.approx(whole_numbers(reach, n, m), rel=1e-9, abs=1e-13)


def test_sizes_choose_the_method():
    assert kolmogorov.p_value(0.1, 10_001, 50) == kolmogorov.asymptotic_p(0.1 * (10_001 * 50 / 10_051) ** 0.5)
    assert kolmogorov.p_value(0.1, 1000, 50) == kolmogorov.exact_p(5000, 50, 1000) != kolmogorov.asymptotic_p(0.1 * (1000 * 50 / 1050) ** 0.5)


def test_stream_says_what_batch_says(spark, tmp_path):
    rng = np.random.default_rng(8)
    ref = rng.normal(0, 1, 300).round(2)
    x = np.concatenate([rng.normal(0, 1, 120), rng.normal(0.5, 1.2, 60)]).round(2)
    cfg = DriftConfig(window=80)
    rows = [("X", i, float(v)) for i, v in enumerate(x)]
    path = str(tmp_path / "in")
    table = spark.createDataFrame(rows, "symbol string, i long, x double").select("symbol", F.timestamp_seconds("i").alias("ts"), "x")
    table.repartition(1).write.parquet(path)
    stream = spark.readStream.schema("symbol string, ts timestamp, x double").parquet(path)
    live.append_to(live.drift_monitor(stream, {"X": ref.tolist()}, cfg), str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    reference = spark.createDataFrame([("X", float(v)) for v in ref], "symbol string, x double")
    for i in (48, 49, 79, 120, 150, 179):
        want = risk.drift(reference, table.limit(i + 1), cfg).first()
        assert got[i]["drift"] == want["drift"] and got[i]["rows"] == want["rows"]
        if i >= 49:
            assert (got[i]["ks"], got[i]["z"]) == pytest.approx((want["ks"], want["z"]), abs=1e-9)
            assert want["ks_p"] == pytest.approx(whole_numbers(round(want["ks"] * want["rows"] * 300), want["rows"], 300), abs=1e-9)
    assert any(r["drift"] for r in got) and not all(r["drift"] for r in got[49:])
