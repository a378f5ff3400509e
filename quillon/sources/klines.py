"""Bars from a paged kline endpoint, in batch and as a stream: ``spark.read.format("klines")``.

Options: ``url`` (an HTTP endpoint that takes symbol, interval, start, end and limit) or ``folder`` (pages kept as files, see
``write_pages``), ``symbols`` (by commas), ``interval`` (an exchange's name of it), ``start`` and ``end`` (milliseconds),
``limit`` (1000), ``retries`` (30), ``wait`` and ``pause`` (seconds between tries, 2, and pages, 0.08), ``span`` (bars of a partition).

A partition is a stretch of time of one symbol, paged by a cursor. A request that fails is tried again; a page whose retCode isn't 0 is
an error; a page that is empty or doesn't move the cursor ends the stretch. A stream's offset is the cursor of each symbol, so
that it goes on where it was after a restart.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.parse
import urllib.request
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillon.functions.windows import by_time
from quillon.params import INTERVALS
from quillon.sources.bars import BAR_COLUMNS

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, turnover double"
_UNITS = {"minute": 60_000, "minutes": 60_000, "hour": 3_600_000, "hours": 3_600_000, "day": 86_400_000}


def interval_ms(name: str) -> int:
    if name not in INTERVALS:
        raise ValueError(f"unknown interval {name!r}; known: {', '.join(INTERVALS)}")
    number, unit = INTERVALS[name].split()
    return int(number) * _UNITS[unit]


class Http:
    def __init__(self, url: str):
        self.url = url

    def page(self, **query) -> str:
        with urllib.request.urlopen(f"{self.url}?{urllib.parse.urlencode(query)}", timeout=15) as answer:
            return answer.read().decode()


class Folder:
    """Pages as files ``symbol=S/first=MS/...``, one page each, in a folder that pyarrow can open."""

    def __init__(self, path: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(path)
        self.pages: dict[str, list[tuple[int, str]]] = {}

    def _listed(self, symbol: str) -> list[tuple[int, str]]:
        if symbol not in self.pages:
            root = f"{self.path}/symbol={urllib.parse.quote(symbol, safe='')}"
            found = self.fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
            self.pages[symbol] = sorted((int(f.base_name.removeprefix("first=")), f.path) for f in found if f.base_name.startswith("first="))
        return self.pages[symbol]

    def page(self, symbol: str, start: int, end: int, **_) -> str:
        """The first page that begins at the cursor or later."""
        pages = self._listed(symbol)
        for begin, folder in pages[bisect_left(pages, (start, "")) :][:1]:
            if begin < end:
                for f in self.fs.get_file_info(pyarrow.fs.FileSelector(folder)):
                    if f.base_name.startswith("part-"):
                        with self.fs.open_input_stream(f.path) as body:
                            return body.read().decode()
        return '{"retCode": 0, "result": {"list": []}}'


@dataclass
class Stretch(InputPartition):
    symbol: str
    start: int
    end: int


class _Pages:
    """What both readers share."""

    def __init__(self, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        if ("url" in o) == ("folder" in o):
            raise ValueError("one of the options url and folder is needed")
        if not o.get("symbols"):
            raise ValueError("the option symbols is needed")
        self.options = o
        self.symbols = [s.strip() for s in o["symbols"].split(",") if s.strip()]
        self.interval = o.get("interval", "5")
        self.width = interval_ms(self.interval)
        self.start = int(o.get("start", 0))
        self.end = int(o["end"]) if "end" in o else None
        self.limit, self.retries, self.span = int(o.get("limit", 1000)), int(o.get("retries", 30)), int(o.get("span", 50_000))
        self.wait, self.pause = float(o.get("wait", 2)), float(o.get("pause", 0.08))

    def closed(self) -> int:
        """The end of the last bar that is closed by now, or the option ``end`` if that is earlier."""
        now = int(time.time() * 1000) // self.width * self.width
        return now if self.end is None else min(self.end, now)

    def stretches(self, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
        step = self.span * self.width
        return [Stretch(s, a, min(a + step, end[s])) for s in self.symbols for a in range(start[s], end[s], step)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        source = Http(self.options["url"]) if "url" in self.options else Folder(self.options["folder"])
        cursor, tries = partition.start, 0
        while cursor < partition.end:
            try:
                body = json.loads(source.page(symbol=partition.symbol, interval=self.interval, start=cursor, end=partition.end, limit=self.limit))
            except (OSError, ValueError):  # the network, or half a page
                tries += 1
                if tries > self.retries:
                    raise
                time.sleep(self.wait)
                continue
            tries = 0
            if body.get("retCode") != 0:
                raise RuntimeError(f"page with retCode {body.get('retCode')}: {body.get('retMsg', '')}")
            rows = sorted({int(r[0]): r for r in (body.get("result") or {}).get("list") or []}.items())
            if not rows:
                return
            for ms, r in rows:
                if cursor <= ms < partition.end:
                    yield (partition.symbol, dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms), *(float(x) for x in r[1:7]))
            onward = rows[-1][0] + self.width
            if onward <= cursor:
                return
            cursor = onward
            time.sleep(self.pause)


class KlineReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        end = self.closed()
        return self.stretches(dict.fromkeys(self.symbols, self.start), dict.fromkeys(self.symbols, end))


class KlineStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return dict.fromkeys(self.symbols, self.start)

    def latestOffset(self) -> dict:
        return dict.fromkeys(self.symbols, max(self.start, self.closed()))

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        # symbols that are new since the offset was written begin at the start
        return self.stretches({s: start.get(s, self.start) for s in self.symbols}, {s: end.get(s, self.start) for s in self.symbols})

    def commit(self, end: dict) -> None:
        pass


class KlineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KlineReader:
        return KlineReader(self.options)

    def streamReader(self, schema) -> KlineStream:
        return KlineStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KlineSource)


def write_pages(bars: DataFrame, path: str, rows: int = 200) -> None:
    """``bars`` as the pages that an endpoint would give, newest first, for ``folder``."""
    paged = bars.withColumn("page", F.floor((F.row_number().over(by_time()) - 1) / rows))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    text = [ms.cast("string"), *(F.col(c).cast("string") for c in BAR_COLUMNS[2:])]
    listed = F.sort_array(F.collect_list(F.struct("ts", F.array(*text).alias("r"))), asc=False)
    pages = paged.groupBy("symbol", "page").agg(F.min(ms).alias("first"), F.transform(listed, lambda x: x["r"]).alias("list"))
    body = F.to_json(F.struct(F.lit(0).alias("retCode"), F.struct("list").alias("result"))).alias("value")
    pages.select("symbol", "first", body).repartition("symbol").write.partitionBy("symbol", "first").text(path)
