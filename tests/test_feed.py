"""The feed as a data source: retries, filters that take requests away, requests that fail for good."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from barwright.sources.feed import read_feed
from barwright.sources.ingest import parse_columnar, parse_csv, parse_klines


@pytest.fixture
def server():
    asked = Counter()

    class Feed(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            name, year = self.path.strip("/").split("/")
            code = 404 if name == "none" else 500 if name == "down" or asked[self.path] < 2 else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                bodies = {"k": json.dumps({"klines": [f"{year}-01-02,1,2,3,0.5,10", f"{year}-01-03,2,x,3,0.5,10"]}), "csv": f"date,open,high,low,close,volume\n{year}-01-02,1,3,0.5,2,10", "col": json.dumps({"timestamp": [0], "open": [None], "high": [3], "low": [0.5], "close": [2], "volume": [None]})}
                self.wfile.write(bodies[name].encode())

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/{{symbol}}/{{year}}", asked
    s.shutdown()


def test_failing_requests_are_tried_again_and_payloads_parse(spark, server):
    url, asked = server
    rows = read_feed(spark, url, ["k", "csv", "col"], (2020, 2021), wait=0.01).cache()
    assert sorted((r.symbol, r.year, r.attempts) for r in rows.collect()) == [(s, y, 2) for s in ("col", "csv", "k") for y in (2020, 2021)]
    bars = parse_klines(rows.where("symbol = 'k'").select("symbol", "payload"), "payload").collect()
    assert sorted((r.date, r.open, r.high, r.low, r.close, r.volume) for r in bars) == [(f"{y}-01-02", 1, 3, 0.5, 2, 10) for y in (2020, 2021)]
    assert parse_csv(rows.where("symbol = 'csv'").select("symbol", "payload"), "payload").count() == 2
    assert parse_columnar(rows.where("symbol = 'col'").select("symbol", "payload"), "payload").first().open == 2
    rows.unpersist()


def test_filters_take_requests_away(spark, server):
    url, asked = server
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        got = read_feed(spark, url, ["k", "csv", "col"], (2015, 2022), wait=0.01).where("symbol in ('k', 'csv') and year >= 2021 and payload is not null").collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == 4 and set(asked) == {f"/{s}/{y}" for s in ("k", "csv") for y in (2021, 2022)}


def test_requests_that_fail_for_good(spark, server):
    url, asked = server
    assert read_feed(spark, url, ["none"], (2020, 2020), wait=0.01, missing="skip").count() == 0
    with pytest.raises(Exception, match="500"):
        read_feed(spark, url, ["down"], (2020, 2020), wait=0.01, retries=1).collect()
    assert asked["/down/2020"] >= 2
