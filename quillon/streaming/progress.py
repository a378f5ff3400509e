"""What streaming queries do, as a table: a row for each micro-batch with rows, durations and state."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = (
    "query string, run string, name string, batch bigint, ts string, input_rows bigint, rows_per_second double, duration_ms bigint, plan_ms bigint, "
    "state_rows bigint, state_bytes bigint, late_rows bigint, watermark string, event string, message string"
)


class ProgressTable(StreamingQueryListener):
    """Appends to a Parquet table, ``every`` rows at a time and when a query ends. ``event``: "progress", "started" or "terminated"; the
    message is the error that ended a query. Rows that couldn't be written are kept for the next time."""

    def __init__(self, spark: SparkSession, path: str, every: int = 100):
        self.spark, self.path, self.every = spark, path, every
        self.rows: list[tuple] = []
        self.lock = threading.Lock()

    def _add(self, row: tuple, now: bool = False) -> None:
        with self.lock:
            self.rows.append(row)
        if now or len(self.rows) >= self.every:
            self.flush()

    def flush(self) -> None:
        with self.lock:
            if self.rows:
                self.spark.createDataFrame(self.rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)
                self.rows = []

    def onQueryStarted(self, event) -> None:
        self._add((str(event.id), str(event.runId), event.name, None, event.timestamp, *[None] * 8, "started", None))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        spent, state = p.durationMs or {}, p.stateOperators or []
        sums = [sum(getattr(s, k) for s in state) if state else None for k in ("numRowsTotal", "memoryUsedBytes", "numRowsDroppedByWatermark")]
        rate = p.processedRowsPerSecond
        self._add(
            (str(p.id), str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, None if rate is None or rate != rate else float(rate), spent.get("triggerExecution"), spent.get("queryPlanning"),
             *sums, (p.eventTime or {}).get("watermark"), "progress", None)
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add((str(event.id), str(event.runId), *[None] * 11, "terminated", event.exception), now=True)


def log_progress(spark: SparkSession, path: str, every: int = 100) -> ProgressTable:
    """From now on every query of this session is written to ``path``."""
    listener = ProgressTable(spark, path, every)
    spark.streams.addListener(listener)
    return listener
