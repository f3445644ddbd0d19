"""A feed of payloads as a data source: spark.read.format("barwright_feed").

One partition a request, so requests run on the executors side by side; filters on symbol and year take requests away before
anything is fetched, where the session lets Python sources take filters; a request that fails is tried again, and where all tries fail the task fails, which Spark tries again.

Options: url, a template with {symbol} and {year} (http, https or file; a file URL may name a folder, whose files are one
payload); symbols, with commas; years, first-last; retries (2), wait (seconds, doubled each time, 0.5), timeout (25),
missing ("fail", or "skip" for requests that the feed answers with 404 or that have no file)."""

from __future__ import annotations

import glob
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..plans.registry import query
from .bars import bars
from .ingest import ROUND, parse_klines
from .shared import shared_folder

SCHEMA = "symbol string, year int, attempts int, payload string"


def fetch(url: str, timeout: float) -> str:
    """The body of a URL; of a folder, its data files one after another."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme == "file" and os.path.isdir(folder := urllib.request.url2pathname(parts.path)):
        texts = []
        for name in sorted(glob.glob(os.path.join(glob.escape(folder), "part-*"))):
            with open(name, encoding="utf-8") as f:
                texts.append(f.read())
        return "".join(texts)
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept-Encoding": "identity"}), timeout=timeout) as answer:
        return answer.read().decode("utf-8", "replace")


def gone(error: Exception) -> bool:
    return isinstance(error, urllib.error.HTTPError) and error.code == 404 or isinstance(getattr(error, "reason", None), FileNotFoundError)


class Request(InputPartition):
    def __init__(self, symbol: str, year: int, url: str):
        super().__init__((symbol, year))
        self.symbol, self.year, self.url = symbol, year, url


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.symbols = [s for s in options["symbols"].split(",") if s]
        first, _, last = options["years"].partition("-")
        self.years = list(range(int(first), int(last or first) + 1))
        self.retries, self.wait, self.timeout = int(options.get("retries", 2)), float(options.get("wait", 0.5)), float(options.get("timeout", 25))
        self.missing = options.get("missing", "fail")

    def partitions(self) -> list[Request]:
        quoted = lambda x: urllib.parse.quote(str(x), safe="")
        return [Request(s, y, self.url.format(symbol=quoted(s), year=y)) for s in self.symbols for y in self.years]

    def read(self, partition: Request) -> Iterator[tuple]:
        for attempt in range(self.retries + 1):
            try:
                body = fetch(partition.url, self.timeout)
            except OSError as error:  # URL and HTTP errors among them
                if gone(error) and self.missing == "skip":
                    return
                if attempt == self.retries:
                    raise
                time.sleep(self.wait * 2**attempt)
            else:
                yield partition.symbol, partition.year, attempt + 1, body
                return


class PushedReader(FeedReader):
    """For sessions that let Python sources take filters (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on symbol and year as lists of what is left; gives the others back."""
        compare = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b, In: lambda a, b: a in b}
        for f in filters:
            holds, column = compare.get(type(f)), getattr(f, "attribute", None)
            if holds is None or column not in (("symbol",), ("year",)):
                yield f
            elif column == ("symbol",):
                self.symbols = [s for s in self.symbols if holds(s, f.value)]
            else:
                self.years = [y for y in self.years if holds(y, f.value)]


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "barwright_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return (PushedReader if self.options.get("pushed") == "true" else FeedReader)(self.options)


def read_feed(spark: SparkSession, url: str, symbols: list[str], years: tuple[int, int], **options) -> DataFrame:
    """symbol, year, attempts, payload of a feed."""
    spark.dataSource.register(FeedSource)
    reader = spark.read.format("barwright_feed").option("url", url).option("symbols", ",".join(symbols)).option("years", f"{years[0]}-{years[1]}")
    return reader.option("pushed", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).options(**options).load()


@query("source_feed", ROUND, bars=True)
def source_feed(spark, sf_dir):
    """All bars written as payloads of a symbol and a year, then fetched through the source. The shared folder stands in for the
    feed, so it has to be one that file URLs reach."""
    b = bars(spark, sf_dir).withColumn("year", F.year("date"))
    line = F.concat_ws(",", F.col("date").cast("string"), "open", "close", "high", "low", F.col("volume").cast("long").cast("string"))
    p = b.groupBy("symbol", "year").agg(F.array_sort(F.collect_list(line)).alias("k")).select("symbol", "year", F.to_json(F.struct(F.col("k").alias("klines"))).alias("value"))
    at = f"{shared_folder(spark)}/feed-{os.urandom(8).hex()}"
    p.write.partitionBy("symbol", "year").text(at)
    have = p.agg(F.collect_set("symbol"), F.min("year"), F.max("year")).first()  # the feed's list of symbols
    at = "file://" + at if at.startswith("/") else at
    found = read_feed(spark, f"{at}/symbol={{symbol}}/year={{year}}", sorted(have[0]), (have[1], have[2]), missing="skip")
    return parse_klines(found.drop("year", "attempts"), "payload")
