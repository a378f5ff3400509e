"""Every column of the feature matrix against the single operators, whose queries are held against SQL,
and against plain versions where a single operator's query runs on stand-ins."""

import numpy as np
import pandas as pd
import pytest

from quillon.functions.windows import ratio
from quillon.operators import features as ft
from quillon.params import FeatureParams
from quillon.plans import queries as plans

DATA = "/root/testdata/sf0.01"
P = FeatureParams()


@pytest.fixture(scope="module")
def bars(spark):
    return plans.stage(plans.daily(spark, DATA), "matrix_test")


def _frame(df, columns):
    pdf = df.select("symbol", "ts", *columns).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    return pdf.replace([np.inf, -np.inf], np.nan)


@pytest.fixture(scope="module")
def matrix(bars):
    return _frame(ft.feature_matrix(bars, P), ft.MATRIX)


def _same(got, want, columns):
    assert len(got) == len(want) and (got["symbol"] == want["symbol"]).all() and (got["ts"] == want["ts"]).all()
    for c in columns:
        a, b = got[c].to_numpy(float), want[c].to_numpy(float)
        np.testing.assert_array_equal(np.isnan(a), np.isnan(b), err_msg=f"{c}: nulls")
        np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-7, err_msg=c)


def _with_atr(bars):
    return ft.add_atr(bars).withColumn("atr_pct", ratio(ft.F.col("atr_14"), ft.F.col("close")))


def _pivoted(add):
    def run(bars):
        df = ft.add_atr(bars)
        return add(df, ft.zigzag_pivots(df, P.zigzag_atr_mult))

    return run


SINGLE = {
    "returns": (ft.add_returns, ("close", "log_ret", "vol_20", "vol_64", "price_z")),
    "frac_diff": (lambda b: ft.add_frac_diff(b, P.frac_d), ("ffd",)),
    "atr": (_with_atr, ("atr_14", "atr_pct")),
    "macd": (
        lambda b: ft.add_macd(b, P.macd_fast, P.macd_slow, P.macd_signal),
        ("macd_hist_z", "macd_hist_slope", "macd_divergence", "macd_cross_up", "macd_cross_dn"),
    ),
    "stochastic": (
        lambda b: ft.add_stochastic(b, P.stoch_k, P.stoch_d, P.stoch_smooth),
        ("stoch_k", "stoch_spread", "stoch_oversold_dur", "stoch_overbought_dur"),
    ),
    "donchian": (
        lambda b: ft.add_hawkes(ft.add_donchian(ft.add_atr(b), P.donch_n), P.hawkes_decay),
        ("donch_pos", "donch_width_atr", "donch_break_up", "donch_break_dn", "donch_break_strength", "donch_mid_dist_atr", "hawkes_intensity"),
    ),
    "emas": (
        lambda b: ft.add_ema_stack(ft.add_emas(b)),
        ("ema20", "ema50", "ema200", "ema20_slope", "ema50_slope", "ema200_slope", "trend_align"),
    ),
    "adx": (lambda b: ft.add_adx(b, P.adx_n), ("adx", "plus_di", "minus_di", "adx_norm", "di_spread")),
    "rsi": (lambda b: ft.add_rsi(b, P.rsi_n, "rsi"), ("rsi",)),
    "bollinger": (lambda b: ft.add_bollinger(b, P.bb_n, P.bb_k), ("bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct_b", "bb_z")),
    "fibonacci": (_pivoted(ft.add_fibonacci), ("fib_nearest_dist_atr", "fib_nearest_level", "fib_in_golden_zone")),
    "elliott": (_pivoted(ft.add_elliott), ("ew_wave_id", "ew_confidence", "ew_in_wave3", "ew_in_wave5")),
    "hurst": (ft.add_hurst, ("hurst",)),
    "vol_regime": (lambda b: ft.add_vol_regime(ft.add_returns(b)), ("regime",)),
}
REGIME = ("regime_code", "is_trend_up", "is_trend_dn", "is_range", "is_chop", "bb_width_pctl")


def test_no_column_is_left_out():
    named = [c for _, columns in SINGLE.values() for c in columns] + list(REGIME)
    assert sorted(named) == sorted(ft.MATRIX)


@pytest.mark.parametrize("name", SINGLE)
def test_matrix_has_the_single_operators_columns(bars, matrix, name):
    make, columns = SINGLE[name]
    _same(matrix, _frame(make(bars), columns), columns)


def _rank_in_window(x, n=250, least=50):
    out = np.full(len(x), np.nan)
    for i, v in enumerate(x):
        w = x[max(0, i - n + 1) : i + 1]
        w = w[~np.isnan(w)]
        if len(w) >= least and not np.isnan(v):
            out[i] = ((w < v).sum() + ((w == v).sum() + 1) / 2) / len(w)
    return out


def _plain_regime(g):
    adx, align = g["adx"].to_numpy(float), g["trend_align"].to_numpy(float)
    width, spread = _rank_in_window(g["bb_width"].to_numpy(float)), _rank_in_window(g["atr_pct"].to_numpy(float))
    rows, run, last = [], 0, None
    for a, t, w, s in zip(adx, align, width, spread, strict=True):
        sign = 0.0 if np.isnan(t) else float(np.sign(t))
        run, last = (run + 1 if sign == last else 1), sign
        lasting = run >= 30
        strong = lasting and a >= P.adx_trend_th + 10 and abs(t) >= 1
        weak = lasting and a >= P.adx_trend_th + 3 and abs(t) >= 2 / 3
        quiet = (a <= P.adx_range_th + 4 or abs(t) <= 1 / 3) and w <= 0.75
        chop = (a <= P.adx_range_th - 2 and w <= 0.2 and s <= 0.3) or (a <= P.adx_range_th + 2 and s >= 0.85 and not lasting)
        code = 0.0 if quiet else 2 * sign if strong else sign if weak else 0.0
        rows.append((code, code > 0, code < 0, quiet and not (weak or strong or chop), chop, w))
    return pd.DataFrame(rows, columns=REGIME, index=g.index).astype(float)


def test_regime_of_the_real_inputs_matches_a_plain_version(matrix):
    want = matrix[["symbol", "ts"]].join(pd.concat(_plain_regime(g) for _, g in matrix.groupby("symbol")))
    _same(matrix, want, REGIME)
    # the table has bars of more than one kind
    assert matrix["is_range"].sum() > 0 and (matrix["regime_code"] == 0).any()


def test_query_is_the_matrix_of_the_daily_bars(spark, matrix):
    _same(_frame(plans.q33_feature_matrix(spark, DATA), ft.MATRIX), matrix, ft.MATRIX)
