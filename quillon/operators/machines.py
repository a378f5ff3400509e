"""State machines over a symbol's rows that take them as they come: partitioned table functions on Arrow batches.

A machine keeps a few numbers for its symbol, whatever the length of the series; Spark sorts the rows, spilling where it has to,
and hands them over batch by batch. The rules are those of ``recursions``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import recursions as R


class Machine(Protocol):
    #: Columns that it reads, and the DDL of what it gives besides the symbol.
    reads: tuple[str, ...]
    gives: str

    def step(self, rows: dict[str, pa.Array]) -> list[pa.Array]: ...


def run(df: DataFrame, order: str, machine: Callable[[], Machine]) -> DataFrame:
    """What a new ``machine()`` for each symbol gives for the rows of ``df`` (symbol, ...) in the order of ``order``: symbol and its columns."""
    one = machine()
    names = [c.split()[0] for c in one.gives.split(", ")]
    symbol = df.schema["symbol"].dataType.simpleString()

    class Stepper:
        def __init__(self) -> None:
            self.machine = machine()

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            if rows.num_rows:
                out = self.machine.step({c: rows.column(c) for c in one.reads})
                yield pa.table([pa.array([rows.column("symbol")[0].as_py()] * len(out[0]), rows.schema.field("symbol").type), *out], ["symbol", *names])

    steps = F.arrow_udtf(Stepper, returnType=f"symbol {symbol}, {one.gives}")
    narrow = df.select("symbol", *dict.fromkeys([order, *one.reads]))
    return steps(narrow.asTable().partitionBy("symbol").orderBy(order))


def _numbers(x: pa.Array) -> np.ndarray:
    return x.cast(pa.float64()).to_numpy(zero_copy_only=False)


class Cusum:
    """ts of the rows where the cumulated return ``r`` passes ``h``."""

    reads, gives = ("ts", "r", "h"), "ts timestamp_ntz"

    def __init__(self) -> None:
        self.carry = [0.0, 0.0]

    def step(self, rows: dict[str, pa.Array]) -> list[pa.Array]:
        fired = R.cusum_flags(_numbers(rows["r"]), _numbers(rows["h"]), self.carry)
        return [rows["ts"].filter(pa.array(fired == 1))]


class OnePosition:
    """(e, exit_n) of the intervals that begin after the last one taken has ended."""

    reads, gives = ("e", "exit_n"), "e bigint, exit_n bigint"

    def __init__(self) -> None:
        self.carry = [-1]

    def step(self, rows: dict[str, pa.Array]) -> list[pa.Array]:
        e, leave = (rows[c].cast(pa.int64()) for c in ("e", "exit_n"))
        taken = pa.array(R.one_at_a_time(e.to_pylist(), leave.to_pylist(), self.carry))
        return [e.filter(taken), leave.filter(taken)]


class Zigzag:
    """Pivots (ts, confirmed, price, kind), each when it is confirmed; ``move`` is the reversal that confirms one."""

    reads, gives = ("ts", "high", "low", "close", "move"), "ts timestamp_ntz, confirmed timestamp_ntz, price double, kind int"

    def __init__(self) -> None:
        self.open: set[int] | None = None
        self.best, self.at, self.last = np.nan, None, None

    def step(self, rows: dict[str, pa.Array]) -> list[pa.Array]:
        ts, high, low, close, move = rows["ts"].to_pylist(), *(_numbers(rows[c]).tolist() for c in ("high", "low", "close", "move"))
        found, first = [], 0
        if self.open is None:  # both legs are open and share the first close
            self.open, self.best, self.at, first = {1, -1}, close[0], ts[0], 1
        for i in range(first, len(ts)):
            for leg in (1, -1):
                if leg not in self.open:
                    continue
                ahead, behind = (high[i], low[i]) if leg == 1 else (low[i], high[i])
                if leg * (ahead - self.best) > 0:
                    self.best, self.at = ahead, ts[i]
                elif leg * (self.best - behind) > move[i]:
                    if self.at != self.last:  # a row is a pivot once
                        found.append((self.at, ts[i], self.best, leg))
                        self.last = self.at
                    self.open, self.best, self.at = {-leg}, behind, ts[i]
        columns = zip(*found, strict=True) if found else ((), (), (), ())
        return [pa.array(list(c), t) for c, t in zip(columns, (pa.timestamp("us"), pa.timestamp("us"), pa.float64(), pa.int32()), strict=True)]
