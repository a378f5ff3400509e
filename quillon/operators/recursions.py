"""Recursions over a symbol's bars, as numpy kernels run once for each symbol.

These have no bounded frame, so they can't be window expressions. Inputs that can be are computed
before; one call makes all recursive columns that a caller needs, in one exchange. A kernel holds
one symbol's rows in memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def per_symbol(df: DataFrame, kernel: Callable[[pd.DataFrame], Mapping[str, np.ndarray]], added: Mapping[str, str]) -> DataFrame:
    """``df`` with the columns ``added`` (name to type) that ``kernel`` makes from a symbol's rows in the
    order of ts. Missing values come and go as NaN inside, as NULL outside."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in added.items())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        return pdf.assign(**kernel(pdf))[schema.names]

    return df.groupBy("symbol").applyInPandas(run, schema)


def ewm_mean(x, alpha: float, min_periods: int = 0) -> np.ndarray:
    """y = (1 - alpha) y + alpha x from the first value on; a gap lets the old weight decay."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=min_periods).mean().to_numpy()


def ema(x, n: int) -> np.ndarray:
    return ewm_mean(x, 2 / (n + 1), n)


def wilder(x, n: int) -> np.ndarray:
    return ewm_mean(x, 1 / n, n)


def ewm_std(x, span: int, min_periods: int) -> np.ndarray:
    """Bias-corrected standard deviation with weights (1 - alpha)^age."""
    return pd.Series(x).ewm(span=span, min_periods=min_periods).std().to_numpy()


def decayed_count(x, decay: float, gain: float = 1.0) -> np.ndarray:
    """c = (1 - decay) c + gain x, from 0; missing values count as 0."""
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    values = np.concatenate([[0.0], np.nan_to_num(np.asarray(x, float))])
    return ewm_mean(values, decay)[1:] * gain / decay


def ffd_weights(d: float, threshold: float = 1e-5, most: int = 10_000) -> np.ndarray:
    """Weights of fractional differencing, oldest first, down to the threshold."""
    k = np.arange(1, most)
    tail = np.cumprod(-(d - k + 1) / k)
    small = np.flatnonzero(np.abs(tail) < threshold)
    return np.concatenate([[1.0], tail[: small[0] if len(small) else len(tail)]])[::-1]


def frac_diff(x, d: float, threshold: float = 1e-5) -> np.ndarray:
    """Fixed-width fractional differencing; missing where the window isn't full or has a gap."""
    x, w = np.asarray(x, float), ffd_weights(d, threshold)
    out = np.full(len(x), np.nan)
    if len(x) >= len(w):
        out[len(w) - 1 :] = np.convolve(x, w[::-1], "valid")
    return out


def cusum_flags(returns, thresholds, carry: list[float] | None = None) -> np.ndarray:
    """1 where the sum of returns since the last event on a side, floored at 0, passes the threshold.

    Both sides run on; only the side that passes starts again, and the upper one is looked at first.
    Missing returns change nothing. ``carry`` holds both sums before the first row, and then those after the last.
    """
    up, down = carry or (0.0, 0.0)
    out = np.zeros(len(returns), np.int32)
    for i, (r, h) in enumerate(zip(returns, thresholds, strict=True)):
        if r != r:
            continue
        up, down = max(0.0, up + r), min(0.0, down + r)
        if up > h:
            up, out[i] = 0.0, 1
        elif down < -h:
            down, out[i] = 0.0, 1
    if carry is not None:
        carry[:] = [up, down]
    return out


def fill_numbers(amounts, thresholds) -> np.ndarray:
    """Number of the bucket that each amount falls into, from 0: a bucket is closed by the amount that
    reaches the threshold and the excess is not carried on. -1 for the bucket that stays open."""
    total, number = 0.0, 0
    out = np.empty(len(amounts), np.int64)
    for i, (x, h) in enumerate(zip(amounts, thresholds, strict=True)):
        out[i] = number
        total += x
        if total >= h:
            total, number = 0.0, number + 1
    out[out == number] = -1
    return out


def skip_after(fired, n: int) -> np.ndarray:
    """True for the n rows after each firing row that isn't itself skipped."""
    out = np.zeros(len(fired), bool)
    free = 0
    for i in np.flatnonzero(fired):
        if i >= free:
            out[i + 1 : i + 1 + n] = True
            free = i + 1 + n
    return out


def one_at_a_time(entry, leave, carry: list[int] | None = None) -> np.ndarray:
    """True for the intervals [entry, leave] that begin after the last one taken has ended, in order. ``carry`` holds its end."""
    out = np.zeros(len(entry), bool)
    free = carry[0] if carry else -1
    for i, (a, b) in enumerate(zip(entry, leave, strict=True)):
        if a > free:
            out[i], free = True, b
    if carry is not None:
        carry[0] = free
    return out


def zigzag(high, low, close, reversal) -> list[tuple[int, int, float, int]]:
    """Pivots (row, row of confirmation, price, +1 high or -1 low), one for each row at most.

    The extreme of the running leg is followed; a move of more than ``reversal`` against it makes it
    a pivot and starts the other leg at once, which is then looked at in the same row. Until the
    first pivot both legs are open and share one extreme, which starts at the first close.
    """
    legs = (1, -1)
    price = {1: high, -1: low}
    open_legs, best, row = set(legs), close[0] if len(close) else np.nan, 0
    found: dict[int, tuple[int, int, float, int]] = {}
    for i in range(1, len(close)):
        for leg in legs:
            if leg not in open_legs:
                continue
            ahead, behind = price[leg][i], price[-leg][i]
            if leg * (ahead - best) > 0:
                best, row = ahead, i
            elif leg * (best - behind) > reversal[i]:
                found.setdefault(row, (row, i, best, leg))
                open_legs, best, row = {-leg}, behind, i
    return list(found.values())


# --- kernels of features -------------------------------------------------------------------------


def adx_kernel(p: pd.DataFrame, n: int) -> dict[str, np.ndarray]:
    with np.errstate(divide="ignore", invalid="ignore"):
        span = wilder(p["__tr"], n)
        span = np.where(span == 0, np.nan, span)
        plus, minus = (100 * wilder(p[c], n) / span for c in ("__plus", "__minus"))
        both = np.where(plus + minus == 0, np.nan, plus + minus)
        # where the index is unknown it counts as 0, so the average starts at 0 on the first row
        adx = wilder(np.nan_to_num(100 * np.abs(plus - minus) / both), n)
    return {"adx": adx, "plus_di": plus, "minus_di": minus, "adx_norm": np.clip(adx / 100, 0, 1), "di_spread": plus - minus}


def rsi_kernel(change: pd.Series, n: int) -> np.ndarray:
    """NULL while there are no losses at all."""
    gain, loss = wilder(change.clip(lower=0), n), wilder(-change.clip(upper=0), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 100 - 100 / (1 + gain / np.where(loss == 0, np.nan, loss))


def macd_kernel(close: pd.Series, fast: int, slow: int, signal: int) -> dict[str, np.ndarray]:
    macd = ema(close, fast) - ema(close, slow)
    return {"__macd": macd, "__sig": ema(macd, signal)}


def gaussian_regimes(returns: np.ndarray, n_states: int = 3, rounds: int = 50, seed: int = 42) -> np.ndarray:
    """Most likely states of a hidden Markov model with diagonal Gaussians on (r, |r|), fitted by
    expectation maximisation from quantiles of |r|; states are numbered by volatility."""
    r = np.nan_to_num(np.asarray(returns, float))
    x = np.column_stack([r, np.abs(r)])
    n, k = len(x), n_states
    if n < 10 * k or not x.std():
        return np.zeros(n)
    cuts = np.quantile(x[:, 1], np.linspace(0, 1, k + 1)[1:-1])
    start = np.searchsorted(cuts, x[:, 1])
    mean = np.array([x[start == s].mean(0) if (start == s).any() else x.mean(0) for s in range(k)])
    var = np.array([x[start == s].var(0) if (start == s).any() else x.var(0) for s in range(k)]) + 1e-12
    move, first = np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1)), np.full(k, 1 / k)

    def likelihood() -> np.ndarray:
        return -0.5 * (((x[:, None] - mean) ** 2) / var + np.log(2 * np.pi * var)).sum(2)

    for _ in range(rounds):
        logs = likelihood()
        shift = logs.max(1, keepdims=True)
        b = np.exp(logs - shift)
        alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
        for t in range(n):
            a = first * b[0] if t == 0 else (alpha[t - 1] @ move) * b[t]
            scale[t] = a.sum() or 1e-300
            alpha[t] = a / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        joint = move * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
        move, first = joint / joint.sum(1, keepdims=True), gamma[0]
        weight = gamma.sum(0)[:, None]
        mean = gamma.T @ x / weight
        var = np.maximum(gamma.T @ x**2 / weight - mean**2, 1e-12)
    logs, steps = likelihood(), np.log(move + 1e-300)
    best, back = np.log(first + 1e-300) + logs[0], np.zeros((n, k), int)
    for t in range(1, n):
        options = best[:, None] + steps
        back[t], best = options.argmax(0), options.max(0) + logs[t]
    path = np.empty(n, int)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return np.argsort(np.argsort(var[:, 0]))[path].astype(float)


def adf_p_value(statistic: float) -> float:
    """Asymptotic probability of a statistic this low under a unit root, for a test with a constant:
    MacKinnon's (1994) polynomials, whose limits and coefficients are fixed values."""
    if statistic > 2.74:
        return 1.0
    if statistic < -18.83:
        return 0.0
    small, large = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
    return NormalDist().cdf(sum(c * statistic**k for k, c in enumerate(small if statistic <= -1.61 else large)))


def adf_statistic(x: np.ndarray) -> float:
    """t statistic of the level in a regression of changes on level, last change and constant."""
    change = np.diff(x)
    design = np.column_stack([x[1:-1], change[:-1], np.ones(len(change) - 1)])
    target = change[1:]
    inverse = np.linalg.pinv(design.T @ design)
    beta = inverse @ design.T @ target
    rest = target - design @ beta
    variance = rest @ rest / max(len(target) - 3, 1)
    return float(beta[0] / math.sqrt(max(variance * inverse[0, 0], 1e-300)))




def rolling_hurst(close, window: int = 256, max_lag: int = 64) -> np.ndarray:
    """For each row the slope of log deviation against log lag of the ``window`` values before it."""
    x = np.asarray(close, float)
    out = np.full(len(x), np.nan)
    lags = np.arange(2, max_lag)
    for begin in range(window, len(x), 4096):
        rows = np.arange(begin, min(begin + 4096, len(x)))
        part = x[begin - window : rows[-1]]
        taus = np.empty((len(rows), len(lags)))
        for j, k in enumerate(lags):
            taus[:, j] = np.lib.stride_tricks.sliding_window_view(part[k:] - part[:-k], window - k).std(axis=1)
        good = taus > 0
        number = np.cumsum(good, axis=1)
        n = number[:, -1]
        log_lag = np.where(good, np.log(number + 1.0), 0.0)
        log_tau = np.log(np.where(good, taus, 1.0))
        sx, sy = log_lag.sum(1), log_tau.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (n * (log_lag * log_tau).sum(1) - sx * sy) / (n * (log_lag**2).sum(1) - sx**2)
        out[rows] = np.where(n >= 5, slope, 0.5)
    return out
