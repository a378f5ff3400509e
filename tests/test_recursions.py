"""Kernels against plain step-by-step versions."""

import numpy as np
import pandas as pd
import pytest

from quillon.operators import recursions as R


def steps(x, alpha):
    out, y = [], None
    for v in x:
        y = v if y is None else (1 - alpha) * y + alpha * v
        out.append(y)
    return np.array(out)


def test_ema_seeds_at_the_first_value():
    x = np.random.default_rng(1).normal(100, 5, 300)
    got = R.ema(x, 20)
    assert np.isnan(got[:19]).all()
    np.testing.assert_allclose(got[19:], steps(x, 2 / 21)[19:], rtol=1e-12)


def test_a_gap_decays_the_old_weight():
    assert R.ewm_mean([np.nan, 1, np.nan, 3], 0.5)[-1] == pytest.approx(7 / 3)


def test_decayed_count():
    x = np.array([0, 1, 0, np.nan, 1, 1.0])
    want, c = [], 0.0
    for v in np.nan_to_num(x):
        c = 0.9 * c + 2 * v
        want.append(c)
    np.testing.assert_allclose(R.decayed_count(x, 0.1, 2.0), want)
    with pytest.raises(ValueError):
        R.decayed_count(x, 1.0)


@pytest.mark.parametrize(("d", "width"), [(0.4, 1457), (0.8, 227), (0.2, 3381)])
def test_ffd_width(d, width):
    assert len(R.ffd_weights(d)) - 1 == width


def test_frac_diff_is_a_dot_product():
    x = np.random.default_rng(2).normal(size=400).cumsum()
    w = R.ffd_weights(0.8)
    got = R.frac_diff(x, 0.8)
    assert np.isnan(got[: len(w) - 1]).all()
    assert got[350] == pytest.approx(w @ x[350 - len(w) + 1 : 351])
    x[380] = np.nan
    assert np.isnan(R.frac_diff(x, 0.8)[380:]).all()


def test_cusum_resets_one_side_only():
    r = [0.6, 0.6, -0.2, 0.9, -3.0, 0.1]
    assert R.cusum_flags(r, [1.0] * 6).tolist() == [0, 1, 0, 0, 1, 0]


def test_fill_numbers_drops_the_excess():
    assert R.fill_numbers([5, 5, 12, 3, 8, 1], [10] * 6).tolist() == [0, 0, 1, 2, 2, -1]


def test_skip_after():
    assert R.skip_after(np.array([1, 1, 0, 0, 1, 0, 0]) > 0, 2).tolist() == [False, True, True, False, False, True, True]


def test_one_at_a_time():
    assert R.one_at_a_time([0, 3, 5, 6, 9], [5, 4, 7, 8, 9]).tolist() == [True, False, False, True, True]


def test_zigzag_takes_the_extreme_as_pivot():
    # a gap down confirms the high, then a gap up the low
    high, low, close = [10, 12, 11, 6, 5, 9, 13], [9, 11, 10.5, 5, 4, 8, 12], [10, 12, 11, 5, 4, 9, 13]
    found = R.zigzag(np.array(high, float), np.array(low, float), np.array(close, float), np.full(7, 2.0))
    assert [f[3] for f in found] == sorted([f[3] for f in found], key=[f[3] for f in found].index)
    assert all(a[3] != b[3] for a, b in zip(found, found[1:], strict=False))
    assert found and all(f[0] <= f[1] for f in found)


def test_rsi_and_adx_have_known_limits():
    p = pd.DataFrame({"close": np.linspace(1, 2, 50)})
    assert np.isnan(R.rsi_kernel(p["close"].diff(), 14)).all()


def test_hurst_of_a_random_walk():
    x = np.random.default_rng(3).normal(size=3000).cumsum()
    got = R.rolling_hurst(x)
    assert np.isnan(got[:256]).all() and 0.3 < np.nanmean(got) < 0.55  # short windows bias it downwards
    i = 700
    part, taus = x[i - 256 : i], []
    for k in range(2, 64):
        taus.append((part[k:] - part[:-k]).std())
    assert got[i] == pytest.approx(np.polyfit(np.log(np.arange(2, 64)), np.log(taus), 1)[0])


def test_gaussian_regimes_separate_volatility():
    rng = np.random.default_rng(4)
    r = np.concatenate([rng.normal(0, 0.001, 400), rng.normal(0, 0.05, 400)])
    got = R.gaussian_regimes(r, 2)
    assert (got[:390] == 0).mean() > 0.9 and (got[410:] == 1).mean() > 0.9


def test_adf():
    rng = np.random.default_rng(5)
    assert R.adf_statistic(rng.normal(size=500)) < -10
    assert R.adf_statistic(rng.normal(size=500).cumsum()) > -3.5
