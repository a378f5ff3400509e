"""Streaming: bars from ticks, incremental recursions, drift, and sinks.

The batch operators' semantics, except that nothing looks ahead: thresholds aren't filled from later
rows and pivots count from their confirmation.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.kolmogorov import p_value
from quillon.params import DriftConfig


def streaming_bars(ticks: DataFrame, width: str, late: str = "1 minute") -> DataFrame:
    """Bars of closed windows (append mode); ticks later than ``late`` behind the newest are dropped."""
    good = ticks.filter((F.col("price") > 0) & (F.col("price") < float("inf"))).withWatermark("ts", late)
    return (
        good.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", "tie").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "tie").alias("close"),
            F.sum("volume").alias("volume"),
            F.round(F.sum("turnover"), 2).alias("turnover"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "turnover")
    )


def unique_bars(bars: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each bar once, however often a source repeats it."""
    return bars.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


SIGNALS = "symbol string, ts timestamp, close double, log_ret double, ema double, hawkes double, event int, cooling boolean"
_STATE = "close double, ema double, hawkes double, up double, down double, returns array<double>, free bigint, n bigint"


def recursive_features(bars: DataFrame, span: int = 20, decay: float = 0.1, lookback: int = 100, mult: float = 2.0, cooldown: int = 5) -> DataFrame:
    """One row per bar with an exponential mean, decayed count of events, CUSUM events (by the deviation
    of the last ``lookback`` returns, from 20 on) and whether it lies in the cool-down of an event.

    State per symbol is O(lookback). A symbol's bars are taken in the order of ts within a batch.
    """
    alpha = 2 / (span + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        close, ema, hawkes, up, down, past, free, n = state.get if state.exists else (None, None, 0.0, 0.0, 0.0, [], 0, 0)
        past = list(past)
        pdf = pd.concat(list(batches)).sort_values("ts", ignore_index=True)
        out = []
        for ts, price in zip(pdf["ts"], pdf["close"], strict=True):
            ret = np.log(price / close) if close else np.nan
            ema = price if ema is None else (1 - alpha) * ema + alpha * price
            fired = 0
            if ret == ret:
                past = [*past, float(ret)][-lookback:]
                up, down = max(0.0, up + ret), min(0.0, down + ret)
                limit = mult * np.std(past, ddof=1) if len(past) >= 20 else np.inf
                if up > limit:
                    up, fired = 0.0, 1
                elif down < -limit:
                    down, fired = 0.0, 1
            hawkes = (1 - decay) * hawkes + fired
            cooling = n < free
            if fired and not cooling:
                free = n + 1 + cooldown
            out.append((key[0], ts, price, ret, ema, hawkes, fired, cooling))
            close, n = price, n + 1
        state.update((float(close), float(ema), float(hawkes), float(up), float(down), past, int(free), int(n)))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "log_ret", "ema", "hawkes", "event", "cooling"])

    own = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close")
    return own.groupBy("symbol").applyInPandasWithState(step, SIGNALS, _STATE, "append", GroupStateTimeout.NoTimeout)


DRIFT = "symbol string, ts timestamp, rows int, z double, ks double, drift boolean"


def drift_monitor(values: DataFrame, reference: dict[str, list[float]], cfg: DriftConfig | None = None) -> DataFrame:
    """Drift of each symbol's last ``window`` values (symbol, ts, x) against a fixed reference sample of
    bounded size; no drift below 50 values or without a reference."""
    cfg = cfg or DriftConfig()
    samples = {k: np.sort(np.asarray(v, float)) for k, v in reference.items()}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values("ts", ignore_index=True)
        ref, out = samples.get(key[0]), []
        live = sorted(window)  # kept in order: a value goes out and one comes in
        sum_ = math.fsum(window)
        for ts, x in zip(pdf["ts"], pdf["x"].astype(float), strict=True):
            window.append(x)
            insort(live, x)
            sum_ += x
            if len(window) > cfg.window:
                gone = window.pop(0)
                del live[bisect_left(live, gone)]
                sum_ -= gone
            if ref is None or len(window) < 50:
                out.append((key[0], ts, len(window), None, None, False))
                continue
            now = np.array(live)
            at = np.concatenate([ref, now])
            ks = np.abs(np.searchsorted(ref, at, "right") / len(ref) - np.searchsorted(now, at, "right") / len(now)).max()
            z = (sum_ / len(now) - ref.mean()) / (ref.std() + 1e-9) * np.sqrt(len(now))
            far = abs(z) > cfg.mean_z_threshold or p_value(float(ks), len(now), len(ref)) < cfg.ks_p_threshold
            out.append((key[0], ts, len(window), z, ks, bool(far)))
        state.update((window,))
        yield pd.DataFrame(out, columns=["symbol", "ts", "rows", "z", "ks", "drift"])

    own = values.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("x").cast("double").alias("x"))
    return own.groupBy("symbol").applyInPandasWithState(step, DRIFT, "xs array<double>", "append", GroupStateTimeout.NoTimeout)


def order_intents(signals: DataFrame) -> DataFrame:
    """What a broker would be asked to do: rows with an event outside cool-downs."""
    return signals.filter("event = 1 AND NOT cooling").select("symbol", "ts", "close", F.signum("log_ret").cast("int").alias("side"))


def append_to(df: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Appends each micro-batch to a Parquet table at ``path``; a batch that is repeated after a failure
    overwrites its own part."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
