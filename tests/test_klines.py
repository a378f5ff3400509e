"""The kline source against a small endpoint that pages, stumbles and fails, and against kept pages."""

import datetime as dt
import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quillon.sources import bars as B
from quillon.sources import klines
from quillon.streaming import live

MINUTE = 60_000
START = 1_704_067_200_000  # 2024-01-01


class Endpoint(BaseHTTPRequestHandler):
    seen: list = []
    stumble: set = set()

    def do_GET(self):
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        start, end, symbol = int(q["start"]), int(q["end"]), q["symbol"]
        key = (symbol, start)
        if symbol == "SLOW" and key not in self.stumble:
            self.stumble.add(key)
            return self.send_error(503)
        rows = [[str(t), "1", "2", "0.5", "1.5", "10", str(t // MINUTE % 7)] for t in range(start, min(end, START + 500 * MINUTE), MINUTE)][: int(q["limit"])]
        if symbol == "STUCK":  # always the same page
            rows = rows[:1] if start == START else [[str(START), "1", "2", "0.5", "1.5", "10", "0"]]
        body = {"retCode": 10001, "retMsg": "no such symbol"} if symbol == "WRONG" else {"retCode": 0, "result": {"list": rows[::-1]}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/kline"
    server.shutdown()


def options(url, symbols, minutes, **more):
    return {"url": url, "symbols": symbols, "interval": "1", "start": str(START), "end": str(START + minutes * MINUTE), "limit": "100", "pause": "0", "wait": "0.05", **more}


def test_pages_are_followed_and_failures_tried_again(spark, url):
    klines.register(spark)
    got = spark.read.format("klines").options(**options(url, "FAST, SLOW", 800, span="200")).load()
    assert got.columns == list(B.BAR_COLUMNS) and got.count() == 1000  # there are 500 bars
    assert got.rdd.getNumPartitions() == 8
    by = {r["symbol"]: r for r in got.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.countDistinct("ts").alias("n")).collect()}
    assert all((r["a"], r["b"], r["n"]) == (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 8, 19), 500) for r in by.values())


def test_errors_and_no_progress(spark, url):
    klines.register(spark)
    read = lambda symbols, **o: spark.read.format("klines").options(**(options(url, symbols, 300) | o)).load()
    with pytest.raises(Exception, match="retCode 10001"):
        read("WRONG").collect()
    assert read("STUCK").count() == 1
    with pytest.raises(Exception, match="(?i)refused|urlopen|error"):
        read("FAST", url="http://127.0.0.1:9/none", retries="1").collect()
    with pytest.raises(Exception, match="symbols is needed"):
        read("").collect()
    with pytest.raises(Exception, match="unknown interval"):
        read("FAST", interval="7").collect()


def test_a_stream_goes_on_from_its_offset(spark, url, tmp_path):
    klines.register(spark)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    for minutes in (120, 120, 310):
        stream = spark.readStream.format("klines").options(**options(url, "FAST", minutes)).load()
        live.append_to(stream, out, checkpoint, once=True).awaitTermination()
        got = spark.read.parquet(out)
        assert got.count() == got.select("ts").distinct().count() == minutes


def test_kept_pages_give_the_bars_back(spark, tmp_path):
    klines.register(spark)
    bars = B.synthetic(spark, "trending", 950, 5).withColumn("symbol", F.lit("a/b=c"))
    klines.write_pages(bars, str(tmp_path / "pages"))
    o = {"folder": f"file://{tmp_path}/pages", "symbols": "a/b=c,none", "interval": "5", "start": str(START), "end": str(START + 10**10), "pause": "0"}
    got = spark.read.format("klines").options(**o).load()
    assert got.exceptAll(bars.select(*B.BAR_COLUMNS)).count() == 0 and got.count() == 950
