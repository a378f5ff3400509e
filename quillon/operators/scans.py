"""Recursions that run through blocks of a series and carry a small state from one to the next.

A scan says what a block does to the state it begins in, without knowing that state (``summary``), how the state
goes on from there (``after``), and what a block's values are once it is known (``run``). States and
summaries are lists of numbers; NaN stands for "none yet". Missing inputs are NaN.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd


class Scan(Protocol):
    def start(self) -> list[float]: ...
    def summary(self, x: np.ndarray) -> list[float]: ...
    def after(self, state: list[float], summary: list[float]) -> list[float]: ...
    def run(self, x: np.ndarray, state: list[float]) -> np.ndarray: ...


def decayed_sum(x: np.ndarray, keep: float, start: float = 0.0) -> np.ndarray:
    """s = keep s + x, from ``start``."""
    with_start = np.concatenate([[start * (1 - keep)], x])
    return pd.Series(with_start).ewm(alpha=1 - keep, adjust=False).mean().to_numpy()[1:] / (1 - keep)


@dataclass(frozen=True)
class Mean:
    """Exponential mean from the first value on; a gap of missing values lets the old weight decay.

    State: the mean, the rows since the last value, and how many values there were. The block's first value makes
    a new mean from the old one; from there the block is affine: ``slope`` times that mean plus ``shift``.
    """

    alpha: float
    min_periods: int = 0

    def start(self) -> list[float]:
        return [np.nan, 0.0, 0.0]

    def _first(self, mean: float, gap: float, value: float) -> float:
        if np.isnan(mean):
            return value
        weight = (1 - self.alpha) ** (gap + 1)
        return (weight * mean + self.alpha * value) / (weight + self.alpha)

    def summary(self, x: np.ndarray) -> list[float]:
        at = np.flatnonzero(~np.isnan(x))
        if not len(at):
            return [float(len(x)), 0.0, np.nan, 1.0, 0.0, 0.0]
        weight = (1 - self.alpha) ** np.diff(at).astype(float)
        keep, new = weight / (weight + self.alpha), self.alpha * x[at[1:]] / (weight + self.alpha)
        later = np.append(np.cumprod(keep[::-1])[::-1], 1.0)  # what is left of each mean at the block's end
        return [float(at[0]), float(len(at)), float(x[at[0]]), float(later[0]), float(new @ later[1:]), float(len(x) - 1 - at[-1])]

    def after(self, state: list[float], summary: list[float]) -> list[float]:
        (mean, gap, n), (lead, found, value, slope, shift, trail) = state, summary
        if not found:
            return [mean, gap + lead, n]
        return [slope * self._first(mean, gap + lead, value) + shift, trail, n + found]

    def run(self, x: np.ndarray, state: list[float]) -> np.ndarray:
        mean, gap, n = state
        known = ~np.isnan(x)
        out = np.full(len(x), mean)
        if known.any():
            first = int(known.argmax())
            rest = x[first:].copy()
            rest[0] = self._first(mean, gap + first, rest[0])
            out[first:] = pd.Series(rest).ewm(alpha=self.alpha, adjust=False).mean()
        return np.where(n + np.cumsum(known) >= max(1, self.min_periods), out, np.nan)


def ema(n: int) -> Mean:
    return Mean(2 / (n + 1), n)


def wilder(n: int) -> Mean:
    return Mean(1 / n, n)


@dataclass(frozen=True)
class Count:
    """c = (1 - decay) c + gain x from 0; missing values count as 0."""

    decay: float
    gain: float = 1.0

    def __post_init__(self) -> None:
        if not 0 < self.decay < 1:
            raise ValueError("decay must lie between 0 and 1")

    def start(self) -> list[float]:
        return [0.0]

    def summary(self, x: np.ndarray) -> list[float]:
        return [(1 - self.decay) ** len(x), float(self.run(x, [0.0])[-1]) if len(x) else 0.0]

    def after(self, state: list[float], summary: list[float]) -> list[float]:
        return [summary[0] * state[0] + summary[1]]

    def run(self, x: np.ndarray, state: list[float]) -> np.ndarray:
        return decayed_sum(self.gain * np.nan_to_num(x), 1 - self.decay, state[0])


@dataclass(frozen=True)
class Deviation:
    """Bias-corrected standard deviation with weights (1 - alpha)^age, alpha = 2 / (span + 1).

    State: sum of weights, of squared weights, mean, weighted sum of squared differences, and the number of values.
    """

    span: int
    min_periods: int

    @property
    def keep(self) -> float:
        return 1 - 2 / (self.span + 1)

    def start(self) -> list[float]:
        return [0.0] * 5

    @staticmethod
    def _joined(old, new):
        """Old moments, whose weights have decayed already, and new ones as one."""
        total = old[0] + new[0]
        apart = new[2] - old[2]
        share = np.divide(new[0], total, out=np.zeros_like(np.asarray(total, float)), where=np.asarray(total) > 0)
        return total, old[1] + new[1], old[2] + apart * share, old[3] + new[3] + apart**2 * old[0] * share

    def _local(self, x: np.ndarray):
        known = ~np.isnan(x)
        base = x[known][0] if known.any() else 0.0
        v = np.where(known, x - base, 0.0)
        w, w2 = decayed_sum(known.astype(float), self.keep), decayed_sum(known.astype(float), self.keep**2)
        s1, s2 = decayed_sum(v, self.keep), decayed_sum(v * v, self.keep)
        mean = np.divide(s1, w, out=np.zeros_like(w), where=w > 0)
        return w, w2, base + mean, np.maximum(s2 - s1 * mean, 0.0)

    def summary(self, x: np.ndarray) -> list[float]:
        return [float(len(x)), *(float(m[-1]) for m in self._local(x)), float((~np.isnan(x)).sum())]

    def after(self, state: list[float], summary: list[float]) -> list[float]:
        fade = self.keep ** summary[0]
        old = (state[0] * fade, state[1] * fade * fade, state[2], state[3] * fade)
        return [*(float(m) for m in self._joined(old, summary[1:5])), state[4] + summary[5]]

    def run(self, x: np.ndarray, state: list[float]) -> np.ndarray:
        fade = self.keep ** np.arange(1, len(x) + 1)
        old = (state[0] * fade, state[1] * fade * fade, np.full(len(x), state[2]), state[3] * fade)
        w, w2, _, c = self._joined(old, self._local(x))
        free = w * w - w2
        # a single value has a rounding error of weights, not a deviation
        good = (state[4] + np.cumsum(~np.isnan(x)) >= max(2, self.min_periods)) & (free > 0)
        return np.sqrt(np.divide(c * w, free, out=np.full(len(x), np.nan), where=good))


@dataclass(frozen=True)
class Last:
    """The last value so far."""

    def start(self) -> list[float]:
        return [np.nan]

    def summary(self, x: np.ndarray) -> list[float]:
        known = x[~np.isnan(x)]
        return [float(known[-1]) if len(known) else np.nan]

    def after(self, state: list[float], summary: list[float]) -> list[float]:
        return state if np.isnan(summary[0]) else summary

    def run(self, x: np.ndarray, state: list[float]) -> np.ndarray:
        return pd.Series(np.concatenate([state, x])).ffill().to_numpy()[1:]
