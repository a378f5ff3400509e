"""Parameters of the operators. Default values are fixed values."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from typing import Any, TypeVar

T = TypeVar("T")


@dataclass(frozen=True)
class FeatureParams:
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    stoch_k: int = 14
    stoch_d: int = 3
    stoch_smooth: int = 3
    donch_n: int = 20
    zigzag_atr_mult: float = 3.0
    hawkes_decay: float = 0.1
    frac_d: float = 0.4
    regime_states: int = 3
    adx_n: int = 14
    rsi_n: int = 14
    bb_n: int = 20
    bb_k: float = 2.0
    adx_trend_th: float = 22.0
    adx_range_th: float = 18.0


@dataclass(frozen=True)
class PrimaryParams:
    """``trend_macd_min``, ``trend_donch_conf``, ``w_*`` and ``regime_*`` are accepted and have no effect."""

    trend_macd_min: float = 0.0
    trend_pullback_k: float = 1.2
    trend_donch_conf: float = 0.0
    trend_align_min: float = 0.33
    range_rsi_lo: float = 38.0
    range_rsi_hi: float = 62.0
    range_pctb_lo: float = 0.20
    range_pctb_hi: float = 0.80
    range_max_adx: float = 24.0
    range_confirm_reversal: bool = True
    min_abs_score: float = 0.45
    cooldown_bars: int = 5
    w_macd: float = 1.0
    w_stoch: float = 1.0
    w_donch: float = 1.2
    w_fib: float = 0.8
    w_ew: float = 0.8
    regime_trending: int = 2
    regime_neutral: int = 1


@dataclass(frozen=True)
class BacktestConfig:
    fee_taker: float = 0.00055
    fee_maker: float = 0.0002
    slippage_bps: float = 3.0
    funding_bps_per_8h: float = 1.0
    starting_equity: float = 10_000.0
    max_leverage: float = 3.0
    risk_per_trade: float = 0.01
    use_maker: bool = False
    trend_pt_atr: float = 3.0
    trend_sl_atr: float = 1.5
    trend_max_hold_bars: int = 72
    trend_trail_atr: float = 2.0
    range_pt_atr: float = 1.5
    range_sl_atr: float = 1.0
    range_max_hold_bars: int = 24
    pt_mult: float = 2.0
    sl_mult: float = 1.0
    max_hold_bars: int = 48
    meta_threshold: float = 0.55
    min_target_frac: float = 0.003
    cost_adj_min_rr: float = 1.3
    max_pt_atr: float = 6.0
    vol_target_ann: float = 0.15
    bars_per_year: int = 365 * 24 * 12
    #: "reference": a trade's equity counts from the exit before it; "exit": from its own exit.
    equity_stamp: str = "reference"

    @property
    def round_trip(self) -> float:
        return 2 * ((self.fee_maker if self.use_maker else self.fee_taker) + self.slippage_bps / 1e4)


@dataclass(frozen=True)
class MetaParams:
    """``max_depth`` -1: no limit. ``subsample`` is accepted and has no effect, as rows are not sampled between trees."""

    num_leaves: int = 31
    max_depth: int = -1
    learning_rate: float = 0.05
    n_estimators: int = 400
    min_child_samples: int = 20
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    reg_alpha: float = 0.0
    reg_lambda: float = 0.0
    threshold: float = 0.55
    seed: int = 42


@dataclass(frozen=True)
class RiskLimits:
    max_leverage: float = 3.0
    risk_per_trade: float = 0.01
    daily_loss_limit: float = 0.03
    max_drawdown: float = 0.15
    max_concurrent_positions: int = 4
    correlation_cap: float = 0.75
    var_limit: float = 0.05
    liquidation_buffer_atr: float = 2.0


@dataclass(frozen=True)
class DriftConfig:
    window: int = 500
    ks_p_threshold: float = 0.01
    mean_z_threshold: float = 3.0


@dataclass(frozen=True)
class RunnerConfig:
    symbols: tuple[str, ...] = ()
    interval: str = "5"
    poll_seconds: int = 30
    history_days: int = 60
    min_bars: int = 300
    min_feature_rows: int = 200


#: Bar intervals by their exchange names, as Spark durations.
INTERVALS = {
    "1": "1 minute", "3": "3 minutes", "5": "5 minutes", "15": "15 minutes", "30": "30 minutes", "60": "1 hour",
    "120": "2 hours", "240": "4 hours", "360": "6 hours", "720": "12 hours", "D": "1 day",
}


def interval(name: str) -> str:
    """Spark duration of a bar interval; unknown names are an error."""
    if name not in INTERVALS:
        raise ValueError(f"unknown interval {name!r}; known: {', '.join(INTERVALS)}")
    return INTERVALS[name]


def apply_overrides(params: T, found: dict[str, Any]) -> T:
    """``params`` with the fields that ``found`` has; other keys are ignored."""
    known = {f.name for f in fields(params)}
    return replace(params, **{k: v for k, v in found.items() if k in known})


def load_overrides(path: str) -> dict[str, Any]:
    """Tuned parameters from a JSON file, flat or under ``best_params``."""
    with open(path) as file:
        found = json.load(file)
    return found.get("best_params", found)
