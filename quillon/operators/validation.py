"""Cross-validation folds and overfitting statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.windows import ratio, running_product

#: Euler-Mascheroni constant (fixed value).
EULER = 0.5772156649


def _folds(n_splits: int) -> dict[str, str]:
    """SQL for the bounds of fold k of n rows: n // splits each, the last takes the rest."""
    return {"first": f"k * (n div {n_splits})", "last": f"CASE WHEN k = {n_splits - 1} THEN n ELSE (k + 1) * (n div {n_splits}) END"}


def _bounds(rows: DataFrame, n_splits: int, embargo: float) -> DataFrame:
    """(symbol, k, first, stop, emb_stop, t_first, t_last): a few rows for each symbol."""
    sizes = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    edge = _folds(n_splits)
    gap = F.greatest(F.ceil(F.col("n") * F.lit(float(embargo))), F.lit(1))
    parts = parts.select("symbol", "k", F.expr(edge["first"]).alias("first"), F.expr(edge["last"]).alias("stop"), "n", gap.alias("gap"))
    parts = parts.withColumn("emb_stop", F.least(F.col("stop") + F.col("gap"), F.col("n"))).filter("first < stop")
    at = rows.select("symbol", F.col("row_no").alias("first"), F.col("ts").alias("t_first"))
    end = rows.select("symbol", (F.col("row_no") + 1).alias("stop"), F.col("ts").alias("t_last"))
    return parts.join(at, ["symbol", "first"]).join(end, ["symbol", "stop"]).select("symbol", "k", "first", "stop", "emb_stop", "t_first", "t_last")


def cpcv_roles(rows: DataFrame, n_splits: int = 6, n_test: int = 2, embargo: float = 0.01) -> DataFrame:
    """(symbol, combo_id, row_no, role) for every combination of test folds; rows: (symbol, row_no, ts,
    event_end). Roles: "test"; "train"; rows in neither are left out: those whose label reaches into a
    test fold and the embargo after each.

    A row's relation to each fold (n_splits rows) is found first and combined for each combination;
    nothing is compared with other rows.
    """
    bounds = _bounds(rows, n_splits, embargo)
    marks = bounds.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("k", "first", "stop", "emb_stop", "t_first", "t_last"))).alias("folds"))
    inside = lambda f: (F.col("row_no") >= f["first"]) & (F.col("row_no") < f["stop"])
    overlap = lambda f: F.coalesce((F.col("event_end") >= f["t_first"]) & (F.col("ts") <= f["t_last"]), F.lit(False))
    after = lambda f: (F.col("row_no") >= f["stop"]) & (F.col("row_no") < f["emb_stop"])
    state = lambda f: F.when(inside(f), F.lit("test")).when(overlap(f) | after(f), F.lit("out")).otherwise(F.lit("train"))
    df = rows.join(marks, "symbol").withColumn("states", F.transform("folds", state))
    # an embargo or purge by one test fold also counts on rows of another one, which stay test rows
    combos = [F.struct(F.lit(i).alias("combo_id"), F.array(*(F.lit(k) for k in c)).alias("ks")) for i, c in enumerate(combinations(range(n_splits), n_test))]
    df = df.select("symbol", "row_no", "states", F.explode(F.array(*combos)).alias("c"))
    seen = F.transform("c.ks", lambda k: F.element_at("states", k + 1))
    role = F.when(F.array_contains(seen, "test"), "test").when(~F.array_contains(seen, "out"), "train")
    return df.select("symbol", F.col("c.combo_id").alias("combo_id"), "row_no", role.alias("role")).filter("role IS NOT NULL")


def purged_kfold_roles(rows: DataFrame, n_splits: int = 5, embargo: float = 0.01) -> DataFrame:
    """(symbol, combo_id, row_no, role) with one test fold at a time."""
    return cpcv_roles(rows, n_splits, 1, embargo)


# --- statistics ----------------------------------------------------------------------------------


def sharpe(returns: DataFrame, ann_factor: float) -> DataFrame:
    """(symbol, sharpe); 0 where returns don't vary."""
    sd = F.stddev_samp("ret")
    return returns.groupBy("symbol").agg(F.when(sd > 0, F.avg("ret") / F.when(sd > 0, sd) * math.sqrt(ann_factor)).otherwise(0.0).alias("sharpe"))


def probabilistic_sharpe(sr: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    """Probability that the true ratio per period exceeds the benchmark; ``kurt`` isn't excess."""
    if n <= 1:
        return 0.0
    spread = max(1 - skew * sr + (kurt - 1) / 4 * sr**2, 1e-9)
    return NormalDist().cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def expected_best(n_trials: int, variance: float) -> float:
    """Expected largest ratio of n trials without skill; minus infinity for one trial."""
    if n_trials == 1:
        return -math.inf
    z = NormalDist().inv_cdf
    return math.sqrt(max(variance, 1e-12)) * ((1 - EULER) * z(1 - 1 / n_trials) + EULER * z(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(sr: float, n: int, skew: float, kurt: float, n_trials: int, variance: float) -> float:
    return probabilistic_sharpe(sr, n, skew, kurt, expected_best(n_trials, variance) if n_trials >= 1 else 0.0)


def sharpe_probabilities(returns: DataFrame, n_trials: int, variance: float) -> DataFrame:
    """(symbol, sr, psr, dsr) from returns (symbol, ret): moments are aggregated, the rest is a few rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, of in (("psr", lambda r: probabilistic_sharpe(r.sr, r.n, r.skew, r.kurt)), ("dsr", lambda r: deflated_sharpe(r.sr, r.n, r.skew, r.kurt, n_trials, variance))):
                pdf[name] = [of(r) if r.sr == r.sr and r.skew == r.skew else np.nan for r in pdf.itertuples()]
            yield pdf[["symbol", "sr", "psr", "dsr"]]

    sd = F.stddev_samp("ret")
    moments = returns.groupBy("symbol").agg(
        (F.avg("ret") / F.when(sd > 0, sd)).alias("sr"), F.count("ret").alias("n"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt")
    )
    return moments.mapInPandas(run, "symbol string, sr double, psr double, dsr double")


def sharpe_score(n: Column, total: Column, squares: Column) -> Column:
    """Mean over deviation of n returns, from their sum and sum of squares."""
    return (total / n) / (F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0))) + 1e-9)


def overfitting_probability(returns: DataFrame, halves: int = 4, score_fn: Callable[[Column, Column, Column], Column] = sharpe_score) -> DataFrame:
    """(pbo, n_combinations) of a long strategy matrix (t, strategy, ret), with t from 0.

    Time is cut into 2 * halves equal blocks, the rest is dropped. Each block gives sums for every
    strategy; a combination's scores follow from those by ``score_fn``, so that data are read once. The
    first strategy by name wins ties.
    """
    blocks = 2 * halves
    sizes = returns.agg(F.countDistinct("strategy").alias("n"), (F.max("t") + 1).alias("len"))
    size = sizes.first()
    if size["n"] < 2 or (size["len"] or 0) < 16:
        return sizes.select(F.lit(0.5).alias("pbo"), F.lit(0).cast("bigint").alias("n_combinations"))
    width = size["len"] // blocks
    used = returns.filter(F.col("t") < width * blocks).withColumn("block", F.expr(f"t div {width}"))
    sums = used.groupBy("strategy", "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    sets = [F.array(*(F.lit(b) for b in c)) for c in combinations(range(blocks), halves)]
    each = sums.select("strategy", "block", "n", "s", "q", F.posexplode(F.array(*sets)).alias("combo", "train"))
    side = F.array_contains("train", F.col("block").cast("int"))
    pick = lambda c, mine: F.sum(F.when(mine, F.col(c)).otherwise(0))
    per = each.groupBy("combo", "strategy").agg(*(pick(c, m).alias(f"{c}{i}") for i, m in enumerate((side, ~side)) for c in ("n", "s", "q")))

    def score(i: int):
        return score_fn(F.col(f"n{i}"), F.col(f"s{i}"), F.col(f"q{i}"))

    scored = per.select("combo", "strategy", score(0).alias("train"), score(1).alias("test"))
    first = Window.partitionBy("combo").orderBy(F.desc("train"), "strategy")
    best = scored.withColumn("best", F.first("test").over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranks = best.groupBy("combo").agg((F.count_if(F.col("test") <= F.col("best")) / F.count(F.lit(1))).alias("rank"))
    return ranks.agg(F.avg((F.col("rank") <= 0.5).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_combinations"))


def _drawn(seed: int, n: int) -> Column:
    """A number below n for each (sim, pos), the same wherever it is computed."""
    key = F.concat_ws("-", F.lit(str(seed)), "sim", "pos")
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def bootstrap(trades: DataFrame, n_sims: int = 2000, horizon: int | None = None, seed: int = 42) -> DataFrame:
    """One row of statistics of resampled trade sequences: mean, median, 5 % and 95 % final return, 5 %
    and mean drawdown. ``trades``: (symbol, e, net_ret), numbered in the order of symbol and e.

    Every draw is a row, joined to the trade it draws; a simulation is one window. No trades give zeros.
    """
    names = ("mean_ret", "median_ret", "p5_ret", "p95_ret", "p5_dd", "mean_dd")
    spark, n = trades.sparkSession, trades.count()
    if not n:
        return spark.range(1).select(*(F.lit(0.0).alias(c) for c in names))
    length = horizon or n
    # one row for each symbol
    sizes = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("symbol").orderBy("e")) - 1
    numbered = trades.withColumn("__row", inside).join(sizes.select("symbol", before.alias("__before")), "symbol")
    numbered = numbered.select((F.col("__before") + F.col("__row")).cast("bigint").alias("i"), "net_ret")
    draws = spark.range(n_sims * length).select(F.expr(f"id div {length}").alias("sim"), (F.col("id") % length).alias("pos"))
    path = Window.partitionBy("sim").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sims = draws.withColumn("i", _drawn(seed, n)).join(numbered, "i").withColumn("grown", running_product(1 + F.col("net_ret"), path))
    sims = sims.withColumn("dd", ratio(F.col("grown"), F.max("grown").over(path)) - 1)
    sims = sims.groupBy("sim").agg((F.max_by("grown", "pos") - 1).alias("final"), F.coalesce(F.min("dd"), F.lit(0.0)).alias("dd"))
    at = lambda c, q: F.percentile(c, F.lit(q))
    return sims.agg(
        F.avg("final").alias("mean_ret"), at("final", 0.5).alias("median_ret"), at("final", 0.05).alias("p5_ret"), at("final", 0.95).alias("p95_ret"), at("dd", 0.05).alias("p5_dd"), F.avg("dd").alias("mean_dd")
    )
