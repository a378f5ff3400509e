"""End-to-end plans: backtest, meta training, parameter search and the robustness report."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.windows import bfill, ffill, row_no
from quillon.operators import backtest, features, labels, meta, risk, signals, tpe, validation
from quillon.params import BacktestConfig, DriftConfig, FeatureParams, MetaParams, PrimaryParams, RunnerConfig, apply_overrides
from quillon.storage import stage, temporary


@dataclass(frozen=True)
class Settings:
    features: FeatureParams = FeatureParams()
    primary: PrimaryParams = PrimaryParams()
    backtest: BacktestConfig = BacktestConfig()

    def with_overrides(self, found: dict) -> "Settings":
        return Settings(*(apply_overrides(p, found) for p in (self.features, self.primary, self.backtest)))


def signal_table(bars: DataFrame, s: Settings) -> DataFrame:
    """Complete feature rows with the primary signal; rows without full history or with a gap are left out."""
    matrix = stage(features.feature_matrix(bars, s.features), "features").na.drop(subset=list(features.MATRIX))
    return stage(signals.primary_signals(matrix, s.primary), "signals")


def backtest_plan(bars: DataFrame, s: Settings | None = None, model: meta.MetaModel | None = None) -> dict[str, DataFrame]:
    """Features, signals, CUSUM events, optionally the meta filter, and the backtest; ATR and mode of the
    signals are used throughout."""
    s = s or Settings()
    table = signal_table(bars, s)
    sides = table.select("symbol", "ts", F.col("primary_side").alias("side"), F.col("primary_mode").alias("mode"))
    events = labels.cusum_events(table.select("symbol", "ts", "close"))
    proba = model.probabilities(table).select("symbol", "ts", "prob") if model else None
    atr = table.select("symbol", "ts", F.col("atr_pct").alias("atr_frac"))
    return backtest.run_backtest(table.select("symbol", "ts", "close"), events, sides, s.backtest, proba, atr)


def last_rows(df: DataFrame) -> DataFrame:
    """The row of each symbol with the largest ts."""
    rest = [c for c in df.columns if c != "symbol"]
    return df.groupBy("symbol").agg(F.max_by(F.struct(*rest), "ts").alias("v")).select("symbol", "v.*")


def last_trades(ledger: DataFrame, n: int = 500) -> DataFrame:
    """The n trades that ended last, the latest first."""
    return ledger.orderBy(F.desc("exit_time"), "symbol", "e").limit(n)


REFERENCE_RETURNS = 1000


def shadow_step(
    bars: DataFrame, s: Settings | None = None, model: meta.MetaModel | None = None, runner: RunnerConfig | None = None, drift: DriftConfig | None = None,
    judged: DataFrame | None = None,
) -> DataFrame:
    """What the last bar of each symbol says, or each of the bars ``judged`` (symbol, ts): symbol, ts, side, score,
    mode, prob, price, atr, atr_pct, vol_64, action.

    Symbols with fewer bars or complete feature rows than ``runner`` asks for are left out, and so are judged bars
    without complete features. The model's threshold sets the side to 0. Action: "halt-drift" where the last
    returns at the bar drift from the REFERENCE_RETURNS before them, else "paper_fill" for a side and "none" without.
    """
    s, runner, drift = s or Settings(), runner or RunnerConfig(), drift or DriftConfig()
    enough = bars.groupBy("symbol").count().filter(F.col("count") >= runner.min_bars).select("symbol")
    table = signal_table(bars.join(enough, "symbol", "left_semi"), s)
    complete = table.groupBy("symbol").count().filter(F.col("count") >= runner.min_feature_rows).select("symbol")
    table = table.join(complete, "symbol", "left_semi").withColumn("n", row_no())
    now = last_rows(table) if judged is None else table.join(judged.select("symbol", "ts"), ["symbol", "ts"], "left_semi")
    scored = model.probabilities(now) if model else now.withColumn("prob", F.lit(None).cast("double"))
    least = model.params.threshold if model else 0.0
    # each judged bar with the returns up to it, as a symbol of its own
    reach = drift.window + REFERENCE_RETURNS
    of_bar = F.concat_ws("/", "symbol", "e").alias("symbol")
    near = labels.band_join(now.select("symbol", (F.col("n") - reach + 1).alias("e")), table.select("symbol", "n", F.col("log_ret").alias("x"), F.col("ts")), reach - 1)
    late = F.col("n") > F.col("e") + REFERENCE_RETURNS - 1
    before, recent = (near.filter(c).select(of_bar, "ts", "x") for c in (~late, late))
    drifts = risk.drift(before, recent, drift).select(F.col("symbol").alias("bar"), "drift")
    side = F.when(F.col("prob") < least, 0).otherwise(F.col("primary_side"))
    own = scored.withColumn("bar", F.concat_ws("/", "symbol", F.col("n") - reach + 1))
    out = own.join(drifts, "bar", "left").withColumn("side", side)
    action = F.when(F.coalesce("drift", F.lit(False)), "halt-drift").when(F.col("side") != 0, "paper_fill").otherwise("none")
    return out.select(
        "symbol", "ts", F.col("side").cast("int").alias("side"), F.col("primary_score").alias("score"), F.col("primary_mode").cast("int").alias("mode"), "prob",
        F.col("close").alias("price"), F.col("atr_14").alias("atr"), "atr_pct", "vol_64", action.alias("action"),
    )


META_EXITS = {"pt": 2.0, "sl": 1.25, "hold": 48}


def meta_training_rows(table: DataFrame) -> DataFrame:
    """Features at events with a side, their label y, from a signal table; targets are the ATR share."""
    events = labels.cusum_events(table.select("symbol", "ts", "close"))
    target = F.greatest(F.coalesce(ffill(F.col("atr_pct")), bfill(F.col("atr_pct"))), F.lit(5e-4))
    own = table.select("symbol", "ts", target.alias("target_vol"), F.col("primary_side").alias("side"))
    chosen = events.join(own.filter("side <> 0"), ["symbol", "ts"])
    labelled = labels.meta_target(labels.triple_barrier(table.select("symbol", "ts", "close"), chosen, **META_EXITS))
    return table.join(labelled.select("symbol", "ts", "y"), ["symbol", "ts"])


def train_meta(bars: DataFrame, s: Settings | None = None, params: MetaParams | None = None) -> meta.MetaModel:
    rows = meta_training_rows(signal_table(bars, s or Settings()))
    return meta.fit(rows, [*features.MATRIX, "primary_score"], params)


# --- parameter search ----------------------------------------------------------------------------

#: Ranges of the search: name, lowest, highest; whole numbers are drawn as such (fixed values).
SPACE = (
    ("macd_fast", 6, 20), ("macd_slow", 21, 60), ("macd_signal", 5, 15), ("stoch_k", 5, 30), ("stoch_d", 2, 10),
    ("stoch_smooth", 2, 8), ("donch_n", 10, 60), ("zigzag_atr_mult", 1.5, 5.0), ("hawkes_decay", 0.02, 0.3),
    ("frac_d", 0.2, 0.8), ("adx_n", 10, 20), ("rsi_n", 10, 20), ("bb_n", 14, 30), ("bb_k", 1.8, 2.5),
    ("adx_trend_th", 18.0, 28.0), ("adx_range_th", 12.0, 20.0), ("trend_macd_min", 0.0, 0.8), ("trend_pullback_k", 0.3, 1.5),
    ("trend_donch_conf", 0.0, 0.6), ("trend_align_min", 0.2, 0.8), ("range_rsi_lo", 22.0, 38.0), ("range_rsi_hi", 62.0, 78.0),
    ("range_pctb_lo", 0.05, 0.25), ("range_pctb_hi", 0.75, 0.95), ("range_max_adx", 15.0, 24.0), ("min_abs_score", 0.25, 0.6),
    ("cooldown_bars", 0, 6), ("trend_pt_atr", 2.0, 4.5), ("trend_sl_atr", 1.0, 2.2), ("trend_max_hold_bars", 36, 120),
    ("trend_trail_atr", 1.2, 3.0), ("range_pt_atr", 1.0, 2.2), ("range_sl_atr", 0.7, 1.3), ("range_max_hold_bars", 12, 48),
)


def draw(n: int, seed: int = 42) -> list[dict[str, float]]:
    """n seeded points of the space."""
    rng = np.random.default_rng(seed)
    pick = lambda a, b: int(rng.integers(a, b + 1)) if isinstance(a, int) else float(rng.uniform(a, b))
    return [{name: pick(a, b) for name, a, b in SPACE} for _ in range(n)]


def fold_scores(table: DataFrame, events: DataFrame, cfg: BacktestConfig, n_splits: int = 6, n_test: int = 2) -> DataFrame:
    """(combo_id, n_events, n_trades, sharpe) of every combination of test folds, in one job: the
    combination becomes part of the symbol."""
    rows = table.select("symbol", "ts", row_no().alias("row_no"))
    ends = labels.vertical_barriers(table, events, cfg.trend_max_hold_bars).select("symbol", "ts", F.col("t1").alias("event_end"))
    rows = rows.join(ends, ["symbol", "ts"], "left").withColumn("event_end", ffill(F.col("event_end")))
    roles = validation.cpcv_roles(rows, n_splits, n_test).filter("role = 'test'")
    tests = roles.join(rows.select("symbol", "row_no", "ts"), ["symbol", "row_no"]).select("symbol", "combo_id", "ts")
    name = F.concat_ws("/", "symbol", F.lpad(F.col("combo_id").cast("string"), 2, "0"))
    own = tests.join(events, ["symbol", "ts"]).select(name.alias("symbol"), "ts")
    counts = own.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_events"))
    combos = F.explode(F.array(*(F.lit(i) for i in range(math.comb(n_splits, n_test))))).alias("combo_id")
    wide = table.select("symbol", "ts", "close", "atr_pct", "primary_side", "primary_mode", combos).withColumn("symbol", name)
    out = backtest.run_backtest(
        wide.select("symbol", "ts", "close"),
        own,
        wide.select("symbol", "ts", F.col("primary_side").alias("side"), F.col("primary_mode").alias("mode")),
        cfg,
        atr=wide.select("symbol", "ts", F.col("atr_pct").alias("atr_frac")),
    )
    return counts.join(out["stats"].select("symbol", "n_trades", "sharpe"), "symbol", "left").select(
        F.substring_index("symbol", "/", -1).cast("int").alias("combo_id"), "n_events", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), "sharpe"
    )


def objective(bars: DataFrame, point: dict[str, float], min_rows: int = 500, min_events: int = 50, min_fold_events: int = 20, min_trades: int = 5) -> dict:
    """Mean less half the deviation of the folds' Sharpe ratios; -10, -5 or -3 where there are too few
    rows, events or folds."""
    s = Settings().with_overrides(point)
    s = replace(s, backtest=replace(s.backtest, meta_threshold=0.0))
    # a symbol's first rows lack fractional differences, so that this many rows are complete at most
    lost = len(features.R.ffd_weights(s.features.frac_d)) - 1
    sizes = bars.groupBy("symbol").count()
    if (sizes.agg(F.sum(F.greatest(F.col("count") - lost, F.lit(0)))).first()[0] or 0) < min_rows:
        return {"value": -10.0, "n_folds": 0}
    table = signal_table(bars, s)
    if table.count() < min_rows:
        return {"value": -10.0, "n_folds": 0}
    events = stage(labels.cusum_events(table.select("symbol", "ts", "close")), "events")
    if events.count() < min_events:
        return {"value": -5.0, "n_folds": 0}
    good = fold_scores(table, events, s.backtest).filter((F.col("n_events") >= min_fold_events) & (F.col("n_trades") >= min_trades) & F.col("sharpe").isNotNull())
    got = good.agg(F.avg("sharpe").alias("mean"), F.stddev_pop("sharpe").alias("sd"), F.count(F.lit(1)).alias("n")).first()
    if not got["n"]:
        return {"value": -3.0, "n_folds": 0}
    return {"value": got["mean"] - 0.5 * (got["sd"] + 1e-9), "mean_sharpe": got["mean"], "std_sharpe": got["sd"], "n_folds": got["n"]}


#: Trials under way at once; their jobs are small and wait for the driver most of the time.
AT_ONCE = 6
TRIALS = "trial int, value double, mean_sharpe double, std_sharpe double, n_folds bigint, params string"
#: Trials of a search.
N_TRIALS = 200


def search(spark: SparkSession, bars: DataFrame, n_trials: int = N_TRIALS, seed: int = 42, at_once: int = AT_ONCE, sampler: str = "tpe", **limits: int) -> DataFrame:
    """The trials (see TRIALS) of a seeded search; each trial is a few distributed jobs, and ``at_once``
    trials are under way together. ``sampler``: "tpe" proposes as many points at a time, from the trials before;
    "random" draws them all at first."""
    space = [tpe.Range(*p) for p in SPACE]
    points, done = draw(n_trials, seed) if sampler == "random" else [], []

    def trial(point: dict[str, float]) -> dict:
        with temporary(spark):
            return objective(bars, point, **limits)

    with ThreadPoolExecutor(at_once) as pool:
        while len(done) < n_trials:
            first = len(done)
            # rounds of random points at the start don't wait for each other
            while sampler != "random" and len(points) < n_trials and (len(points) == first or len(points) < tpe.STARTUP):
                points += tpe.propose(_as_trials(spark, points, done), space, seed + len(points), min(at_once, n_trials - len(points)))
            done += pool.map(trial, points[first:])
    rows = [
        (i, float(got["value"]), got.get("mean_sharpe"), got.get("std_sharpe"), int(got["n_folds"]), json.dumps(point, sort_keys=True))
        for i, (point, got) in enumerate(zip(points, done, strict=True))
    ]
    return spark.createDataFrame(rows, TRIALS)


def _as_trials(spark: SparkSession, points: list[dict], done: list[dict]) -> DataFrame | None:
    if len(done) < tpe.STARTUP:
        return None
    names = [name for name, *_ in SPACE]
    rows = [(i, float(got["value"]), *(float(p[n]) for n in names)) for i, (p, got) in enumerate(zip(points, done, strict=True))]
    return spark.createDataFrame(rows, ", ".join(["trial int", "value double", *(f"{n} double" for n in names)]))


def best_trials(trials: DataFrame, n: int, share: float = 0.1, least: int = 5) -> DataFrame:
    """The best ``share`` of n trials, ``least`` at least; trials without a value come last."""
    return trials.orderBy(F.desc_nulls_last("value"), "trial").limit(max(int(n * share), least))


# --- robustness report ---------------------------------------------------------------------------


def report(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Means of the cells' results by ``keys``, three decimals. Infinite profit factors don't count."""
    pf = F.when(F.abs("profit_factor") < float("inf"), F.col("profit_factor"))
    means = {"n_trades": F.col("n_trades"), "sharpe": F.col("sharpe"), "pf": pf, "win": F.col("win_rate"), "mdd": F.col("max_dd"), "eq_pct": F.col("equity_pct")}
    return cells.groupBy(*keys).agg(*(F.round(F.avg(x), 3).alias(c) for c, x in means.items()))


def rollup_report(cells: DataFrame) -> DataFrame:
    """The report's means by profile and timeframe, by profile and over all, in one aggregation: level (0, 1 or 3, the grouping
    id), profile and tf_min (NULL where summed over), cells, means. A profile that is NULL itself is told apart by the level."""
    pf = F.when(F.abs("profit_factor") < float("inf"), F.col("profit_factor"))
    means = {"n_trades": F.col("n_trades"), "sharpe": F.col("sharpe"), "pf": pf, "win": F.col("win_rate"), "mdd": F.col("max_dd"), "eq_pct": F.col("equity_pct")}
    level = F.grouping_id().cast("int").alias("level")
    return cells.rollup("profile", "tf_min").agg(level, F.count(F.lit(1)).alias("cells"), *(F.round(F.avg(x), 3).alias(c) for c, x in means.items()))


def viability(cells: DataFrame) -> DataFrame:
    """The report by profile and timeframe with a flag: live-ready, avoid or none."""
    df = report(cells, ["profile", "tf_min"])
    ready = (F.col("sharpe") >= 0.8) & (F.col("pf") >= 1.2) & (F.col("mdd") >= -0.20)
    return df.withColumn("flag", F.when(ready, "live-ready").when(F.col("eq_pct") < -10, "avoid").otherwise("none"))


def health(cells: DataFrame) -> DataFrame:
    """One row: cells, trades, and how many cells are profitable or pass each gate."""
    return cells.agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("n_trades").alias("trades"),
        F.count_if(F.col("equity_pct") > 0).alias("profitable"),
        F.count_if(F.col("profit_factor") > 1.2).alias("pf_ok"),
        F.count_if(F.col("sharpe") > 0.8).alias("sharpe_ok"),
        F.count_if(F.col("max_dd") > -0.30).alias("mdd_ok"),
        F.round(F.avg("sharpe"), 6).alias("mean_sharpe"),
        F.round(F.median("sharpe"), 6).alias("median_sharpe"),
    )
