"""Risk of accounts on a stream, as keyed state in RocksDB: breakers, recent returns, signals that expire, and the end of each day.

State of a symbol: the breakers' numbers (a value), its last returns (a list of at most ``RETURNS``), and the last
signal of each side (a map). Timers run on event time: a signal is dropped ``valid`` after it was given, and
a day is closed, with a row of its own, when the watermark passes its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.risk import RiskState
from quillon.params import RiskLimits

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Returns that the value at risk looks at, and the least of them.
RETURNS, LEAST_RETURNS = 500, 100
DAY_MS = 86_400_000
ACCOUNT = (
    "symbol string, ts timestamp, kind string, equity double, daily_return double, drawdown double, halted boolean, "
    "size_multiplier double, value_at_risk double, long_since timestamp, short_since timestamp"
)
_BREAKERS = "equity double, peak double, day string, daily_pnl double, halted boolean, reason string, size_multiplier double"
_NAMES = [f.name for f in fields(RiskState) if f.name != "positions"]


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful queries that start from now on in this session keep their state in RocksDB, which ``account_monitor`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ms(ts: pd.Timestamp) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class _Account(StatefulProcessor):
    def __init__(self, limits: RiskLimits, valid_ms: int):
        self.limits, self.valid_ms = limits, valid_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.breakers = handle.getValueState("breakers", _BREAKERS)
        self.returns = handle.getListState("returns", "ret double")
        self.signals = handle.getMapState("signals", "side int", "at bigint")

    def _now(self) -> RiskState | None:
        return RiskState(*self.breakers.get()) if self.breakers.exists() else None

    def _row(self, symbol: str, ts: pd.Timestamp, kind: str, state: RiskState, returns: list[float]) -> tuple:
        var = -float(np.quantile(returns, 0.05)) if len(returns) >= LEAST_RETURNS else None
        since = [pd.Timestamp(self.signals.getValue((side,))[0], unit="ms") if self.signals.containsKey((side,)) else pd.NaT for side in (1, -1)]
        return (symbol, ts, kind, state.equity, state.daily_pnl / max(state.peak, 1e-9), state.equity / state.peak - 1 if state.peak > 0 else 0.0, state.halted, state.size_multiplier, var, *since)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("ts", ignore_index=True)
        state, out = self._now(), []
        returns = [r[0] for r in self.returns.get()] if self.returns.exists() else []
        timers = set(self.handle.listTimers())
        for ts, equity, side in zip(pdf["ts"], pdf["equity"], pdf["side"], strict=True):
            state = state or RiskState.start(float(equity))
            if state.equity:
                returns = [*returns, float(equity) / state.equity - 1][-RETURNS:] if self.breakers.exists() or out else returns
            state = state.update(float(equity), ts.strftime("%Y-%m-%d"), self.limits)
            wanted = [(_ms(ts) // DAY_MS + 1) * DAY_MS]
            if side == side and side:
                self.signals.updateValue((int(np.sign(side)),), (_ms(ts),))
                wanted.append(_ms(ts) + self.valid_ms)
            for at in wanted:
                if at not in timers:
                    timers.add(at)
                    self.handle.registerTimer(at)
            out.append(self._row(key[0], ts, "equity", state, returns))
        self.breakers.update(tuple(getattr(state, n) for n in _NAMES))
        self.returns.put([(float(r),) for r in returns])
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        state, out = self._now(), []
        gone = [side for side in (1, -1) if self.signals.containsKey((side,)) and self.signals.getValue((side,))[0] + self.valid_ms <= at]
        for side in gone:
            self.signals.removeKey((side,))
        returns = [r[0] for r in self.returns.get()] if self.returns.exists() else []
        if gone:
            out.append(self._row(key[0], pd.Timestamp(at, unit="ms"), "signal expired", state, returns))
        if at % DAY_MS == 0:
            out.append(self._row(key[0], pd.Timestamp(at, unit="ms"), "day closed", state, returns))
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in ACCOUNT.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({n: "datetime64[ns]" for n in ("ts", "long_since", "short_since")} | {"value_at_risk": float})

    def close(self) -> None:
        pass


def account_monitor(events: DataFrame, limits: RiskLimits | None = None, late: str = "10 minutes", valid: str = "1 hour") -> DataFrame:
    """A row (ACCOUNT) for each row of ``events`` (symbol, ts, equity, side: a signal's, else NULL or 0), of kind "equity", and further
    ones for signals that expire ("signal expired") and days that end ("day closed", at midnight, with the last equity's numbers).

    The breakers are those of ``risk.breakers``, row by row, for rows in time order; rows later than ``late`` behind the newest
    of all symbols are dropped. Rows of a symbol are taken in the order of ts within a batch. Times are UTC.
    """
    own = events.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("equity").cast("double").alias("equity"), F.col("side").cast("int").alias("side"))
    processor = _Account(limits or RiskLimits(), int(pd.Timedelta(valid).total_seconds() * 1000))
    return own.withWatermark("ts", late).groupBy("symbol").transformWithStateInPandas(processor, ACCOUNT, "append", "EventTime")


