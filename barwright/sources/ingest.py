"""Feed formats: comma lines in JSON, columnar JSON, pipe tables, wrapped JSON, logs, and the choice among sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from .bars import bars, table

BAR_DDL = "date string, open double, high double, low double, close double, volume double"


def parse_klines(df: DataFrame, payload: str) -> DataFrame:
    """{"klines": ["date,open,close,high,low,volume", ...]} to bar rows; lines without a number for close are dropped."""
    x = df.withColumn("_k", F.explode(F.from_json(payload, "klines array<string>")["klines"])).withColumn("_p", F.split("_k", ","))
    num = lambda k: F.col("_p")[k].try_cast("double")
    return x.select(*[c for c in df.columns if c != payload], F.col("_p")[0].alias("date"), num(1).alias("open"), num(3).alias("high"), num(4).alias("low"), num(2).alias("close"), num(5).alias("volume")).where("close is not null")


def parse_columnar(df: DataFrame, payload: str) -> DataFrame:
    """Parallel arrays: a null close drops the row, other null prices take the close, a null volume is 0."""
    kind = "timestamp array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>"
    x = df.withColumn("_c", F.from_json(payload, kind))
    x = x.withColumn("r", F.explode(F.arrays_zip(*[F.col(f"_c.{n}").alias(n) for n in ("timestamp", "open", "high", "low", "close", "volume")]))).where("r.close is not null")
    price = lambda n: F.coalesce(f"r.{n}", "r.close").alias(n)
    return x.select(*[c for c in df.columns if c != payload], F.to_date(F.timestamp_seconds("r.timestamp")).cast("string").alias("date"), price("open"), price("high"), price("low"), F.col("r.close").alias("close"), F.coalesce("r.volume", F.lit(0.0)).alias("volume"))


def parse_pipe_table(lines: DataFrame, header: str = "| date | open | high | low | last | volume |") -> DataFrame:
    """Rows of a pipe table by the names of its header; `last` is close, missing prices take it, rows without date or close go."""
    names = [c.strip().replace("last", "close") for c in header.strip().strip("|").split("|")]
    x = lines.where(F.col("line").startswith("|") & ~F.col("line").contains("---") & (F.col("line") != header))
    x = x.withColumn("_c", F.transform(F.split(F.regexp_replace("line", r"^\||\|\s*$", ""), r"\|"), lambda c: F.trim(c)))
    cell = {n: F.get("_c", F.lit(k)) for k, n in enumerate(names)}
    num = {n: F.regexp_replace(cell[n], ",", "").try_cast("double") for n in names if n != "date"}
    out = x.select(*[c for c in lines.columns if c != "line"], F.try_to_date(cell["date"], "yyyy-MM-dd").cast("string").alias("date"), num["close"].alias("close"), *[F.coalesce(num[n], num["close"]).alias(n) for n in ("open", "high", "low")], F.coalesce(num["volume"], F.lit(0.0)).alias("volume"))
    return out.where("date is not null and close is not null")


def unwrap_js(c):
    """The JSON of `window.NAME = {...};`."""
    return F.regexp_extract(c, r"(?s)=\s*(\{.*\})\s*;?\s*$", 1)


def first_source(candidates: DataFrame, least: int = 120) -> DataFrame:
    """Of rows (symbol, rank, ...), those of each symbol's first source that has at least `least` rows."""
    best = candidates.groupBy("symbol", "rank").agg(F.count("*").alias("n")).where(F.col("n") >= least).groupBy("symbol").agg(F.min("rank").alias("rank"))
    return candidates.join(best, ["symbol", "rank"], "left_semi")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; corrupt ones are left out."""
    x = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return x.where("_corrupt is null").drop("_corrupt")


def _payloads(b: DataFrame) -> DataFrame:
    """One payload per symbol and year, so that none grows with the series."""
    line = F.concat_ws(",", F.col("date").cast("string"), "open", "close", "high", "low", F.col("volume").cast("long").cast("string"))
    return b.groupBy("symbol", F.year("date")).agg(F.array_sort(F.collect_list(line)).alias("k")).select("symbol", F.to_json(F.struct(F.col("k").alias("klines"))).alias("payload"))


def parse_csv(df: DataFrame, payload: str, header: str = "date,open,high,low,close,volume") -> DataFrame:
    """Payloads of headered comma lines. Payloads that do not begin with the header's first name are no data and give no rows;
    columns go by the names of each payload's own header; rows without date or close go, missing prices take the close."""
    names = header.split(",")
    x = df.withColumn("_l", F.split(F.col(payload), "\r?\n")).withColumn("_h", F.split(F.lower(F.get("_l", F.lit(0))), ",")).where(F.col("_h")[0] == names[0])
    x = x.select(*[c for c in df.columns if c != payload], "_h", F.explode(F.slice("_l", 2, 1 << 30)).alias("_r")).withColumn("_c", F.split("_r", ","))
    cell = lambda n: F.get("_c", (F.array_position("_h", n) - 1).cast("int"))
    num = {n: F.when(F.array_position("_h", n) > 0, cell(n)).try_cast("double") for n in names[1:]}
    out = x.select(*[c for c in df.columns if c != payload], F.try_to_date(cell("date"), "yyyy-MM-dd").cast("string").alias("date"), num["close"].alias("close"), *[F.coalesce(num[n], num["close"]).alias(n) for n in ("open", "high", "low")], F.coalesce(num["volume"], F.lit(0.0)).alias("volume"))
    return out.where("date is not null and close is not null")


def parse_candles(df: DataFrame, payload: str) -> DataFrame:
    """{"data": [[epoch milliseconds, open, high, low, close, volume], ...]} of strings, the newest first."""
    x = df.withColumn("r", F.explode(F.from_json(payload, "data array<array<string>>")["data"]))
    num = lambda k: F.col("r")[k].try_cast("double")
    return x.select(*[c for c in df.columns if c != payload], F.to_date(F.timestamp_millis(F.col("r")[0].cast("long"))).cast("string").alias("date"), num(1).alias("open"), num(2).alias("high"), num(3).alias("low"), num(4).alias("close"), num(5).alias("volume")).where("close is not null")


def parse_any_pipe_table(files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows of pipe tables (one text each, `body`) by the names of each table's own header, in any order and case; aliases rename
    columns. Rows without date or close go, missing prices take the close, a missing volume is 0."""
    aliases = {"last": "close", "vol": "volume", "time": "date"} if aliases is None else aliases
    cells = lambda c: F.transform(F.split(F.regexp_replace(F.trim(c), r"^\||\|$", ""), r"\|"), lambda y: F.trim(y))
    keep = [c for c in files.columns if c != "body"]
    x = files.withColumn("_l", F.filter(F.split("body", "\n"), lambda y: F.trim(y).startswith("|") & ~y.contains("---")))
    names = F.transform(cells(F.get("_l", F.lit(0))), lambda y: F.lower(y))
    alias = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,string>")
    names = F.transform(names, lambda y: F.coalesce(F.try_element_at(alias, y), y))
    x = x.withColumn("_h", names).select(*keep, "_h", F.explode(F.slice("_l", 2, 1 << 30)).alias("_r")).withColumn("_c", cells(F.col("_r")))
    cell = lambda n: F.when(F.array_position("_h", n) > 0, F.get("_c", (F.array_position("_h", n) - 1).cast("int")))
    num = {n: F.regexp_replace(cell(n), ",", "").try_cast("double") for n in ("open", "high", "low", "close", "volume")}
    out = x.select(*keep, F.coalesce(*[F.try_to_date(cell("date"), f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")]).cast("string").alias("date"), num["close"].alias("close"), *[F.coalesce(num[n], num["close"]).alias(n) for n in ("open", "high", "low")], F.coalesce(num["volume"], F.lit(0.0)).alias("volume"))
    return out.where("date is not null and close is not null")


def pipe_lines(b: DataFrame) -> DataFrame:
    """symbol, line: the lines of a pipe table of each symbol, header and rule first, rows by date."""
    cells = [F.col("date").cast("string"), *[F.format_string("%.2f", F.coalesce(c, F.lit(0.0))) for c in ("open", "high", "low", "close")], F.coalesce(F.col("volume"), F.lit(0.0)).cast("long").cast("string")]
    rows = b.select("symbol", F.lit(2).alias("o"), "date", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = b.select("symbol").distinct().select("symbol", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("| date | open | high | low | last | volume |").alias("line")), F.struct(F.lit(1).alias("o"), F.lit("|---|---|---|---|---|---|").alias("line")))).alias("x"))
    return head.select("symbol", "x.o", F.lit(None).cast(dict(b.dtypes)["date"]).alias("date"), "x.line").union(rows)


def write_pipe_tables(b: DataFrame, path: str) -> None:
    """One folder of text per symbol; the lines of a symbol lie in one file, in order."""
    pipe_lines(b).repartition("symbol").sortWithinPartitions("symbol", "o", "date").select("symbol", F.col("line").alias("value")).write.mode("overwrite").partitionBy("symbol").text(path)


def newest_valid(versions: DataFrame, least: int = 120) -> DataFrame:
    """Of rows (symbol, version, ...), those of each symbol's newest version that has at least `least` rows; of its longest one
    where none has."""
    n = versions.groupBy("symbol", "version").agg(F.count("*").alias("n"))
    best = n.groupBy("symbol").agg(F.coalesce(F.max(F.when(F.col("n") >= least, F.col("version"))), F.max_by("version", F.struct("n", "version"))).alias("version"))
    return versions.join(best, ["symbol", "version"], "left_semi")


def load_contract(raw: DataFrame, alternates: DataFrame, least: int = 600) -> DataFrame:
    """Bars that are fit for use: by date, one row a day (the first), business days that are missing taken from the alternates
    (the first that has them), and only of symbols with at least `least` rows."""
    k = F.row_number().over(Window.partitionBy("symbol", "date").orderBy("rank"))
    have = raw.withColumn("rank", F.lit(0))
    span = raw.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    fill = alternates.join(span, "symbol").where("date between a and b and weekday(date) < 5").drop("a", "b")
    every = have.unionByName(fill).withColumn("k", k).where("k = 1").drop("k")
    return every.withColumn("n_", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("n_") >= least).drop("n_")


ROUND = "select symbol, date::varchar as date, open, high, low, close, volume from bars"


@query("source_kline_json", ROUND, bars=True)
def source_kline_json(spark, sf_dir):
    return parse_klines(_payloads(bars(spark, sf_dir)), "payload")


@query("source_columnar_json", ROUND.replace("open, high", "case when i % 9 = 0 then close else open end as open, high"), bars=True)
def source_columnar_json(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("open", F.when(F.col("i") % 9 != 0, F.col("open")))
    rows = b.groupBy("symbol", F.year("date")).agg(F.array_sort(F.collect_list(F.struct(F.unix_seconds(F.col("date").cast("timestamp")).alias("timestamp"), "open", "high", "low", "close", "volume"))).alias("r"))
    p = rows.select("symbol", F.to_json(F.struct(*[F.col(f"r.{n}").alias(n) for n in ("timestamp", "open", "high", "low", "close", "volume")]), {"ignoreNullFields": "false"}).alias("payload"))
    return parse_columnar(p, "payload")


@query("source_pipe_table", ROUND, bars=True)
def source_pipe_table(spark, sf_dir):
    """Written as a pipe table with thousands separators, then read back."""
    b = bars(spark, sf_dir)
    cells = [F.col("date").cast("string"), *[F.format_number(c, 2) for c in ("open", "high", "low", "close")], F.format_number("volume", 0)]
    return parse_pipe_table(b.select("symbol", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))).select("symbol", "date", "open", "high", "low", "close", "volume")


@query("source_wrapped_json", "select symbol, count(*) as n, max(close) as top from bars group by 1", bars=True)
def source_wrapped_json(spark, sf_dir):
    doc = bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.max("close").alias("top"))
    doc = doc.select(F.concat(F.lit("window.DATA = "), F.to_json(F.struct("symbol", "n", "top")), F.lit(";")).alias("js"))
    return doc.select(F.from_json(unwrap_js(F.col("js")), "symbol string, n bigint, top double").alias("d")).select("d.*")


@query("source_fallback", ", c as (select symbol, 1 as rank, close from bars where symbol <> 'N' union all select symbol, 2, close from bars union all select symbol, 0, close from bars where i < 50) select symbol, case when symbol = 'N' then 2 else 1 end as rank, count(*) as n from c where rank = case when symbol = 'N' then 2 else 1 end group by 1", bars=True)
def source_fallback(spark, sf_dir):
    """Of three sources, the first is too short and the second lacks a symbol."""
    b = bars(spark, sf_dir)
    part = lambda rank, f: b.where(f).select("symbol", F.lit(rank).alias("rank"), "close")
    c = part(1, "symbol <> 'N'").union(part(2, "true")).union(part(0, "i < 50"))
    return first_source(c).groupBy("symbol", "rank").agg(F.count("*").alias("n"))


@query("source_props_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def source_props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("source_csv", "select symbol, date::varchar as date, open, high, low, close, volume from bars where symbol <> 'N'", bars=True)
def source_csv(spark, sf_dir):
    """Headered comma lines, columns in another order; one symbol's answer is a page of text, which is no data."""
    b = bars(spark, sf_dir)
    line = F.concat_ws(",", F.col("date").cast("string"), "close", "open", "low", "high", F.col("volume").cast("long").cast("string"))
    p = b.groupBy("symbol", F.year("date")).agg(F.array_sort(F.collect_list(line)).alias("k"))
    body = F.when(F.col("symbol") == "N", F.lit("<html>no such symbol</html>")).otherwise(F.concat(F.lit("Date,Close,Open,Low,High,Volume\n"), F.array_join("k", "\n")))
    return parse_csv(p.select("symbol", body.alias("payload")), "payload")


@query("source_candles", ROUND, bars=True)
def source_candles(spark, sf_dir):
    """Arrays of strings with epoch milliseconds, the newest first."""
    b = bars(spark, sf_dir)
    row = F.array(F.unix_millis(F.col("date").cast("timestamp")).cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")])
    p = b.groupBy("symbol", F.year("date")).agg(F.sort_array(F.collect_list(row), False).alias("data")).select("symbol", F.to_json(F.struct("data")).alias("payload"))
    return parse_candles(p, "payload")


@query("source_any_pipe_table", ROUND, bars=True)
def source_any_pipe_table(spark, sf_dir):
    """Tables with their own header, whose columns come in another order and under other names."""
    b = bars(spark, sf_dir)
    cells = [F.format_number("volume", 0), *[F.format_number(c, 2) for c in ("close", "low", "high", "open")], F.date_format("date", "yyyy/MM/dd")]
    t = b.groupBy("symbol", F.year("date")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))), "\n").alias("k"))
    return parse_any_pipe_table(t.select("symbol", F.concat(F.lit("# bars\n| Vol | Last | Low | High | Open | Time |\n|---|---|---|---|---|---|\n"), F.col("k")).alias("body"))).select("symbol", "date", "open", "high", "low", "close", "volume")


@query("source_closes_only", "select symbol, date::varchar as date, close from bars", bars=True)
def source_closes_only(spark, sf_dir):
    """The loader of closes: two columns of the table, the others are not parsed."""
    b = bars(spark, sf_dir)
    t = pipe_lines(b).where("o = 2").select("symbol", "line")
    c = F.split(F.regexp_replace("line", r"^\||\|\s*$", ""), r"\|")
    return t.select("symbol", F.trim(c[0]).alias("date"), F.trim(c[4]).cast("double").alias("close"))


@query("pipe_table_lines", """select symbol, '| ' || date::varchar || ' | ' || printf('%.2f', open) || ' | ' || printf('%.2f', high) || ' | ' || printf('%.2f', low) || ' | ' || printf('%.2f', close) || ' | ' || volume::bigint::varchar || ' |' as line from bars
  union all select distinct symbol, '| date | open | high | low | last | volume |' from bars union all select distinct symbol, '|---|---|---|---|---|---|' from bars""", bars=True)
def pipe_table_lines(spark, sf_dir):
    """What the sink writes."""
    return pipe_lines(bars(spark, sf_dir)).select("symbol", "line")


@query("source_newest_valid", "select symbol, case when symbol = 'A' then 2 else 1 end as version, count(*) as n from bars group by 1", bars=True)
def source_newest_valid(spark, sf_dir):
    """Of two versions of each series, the newer one is too short for all but one symbol: the old one is taken back."""
    b = bars(spark, sf_dir)
    v = b.select("symbol", "i", F.lit(1).alias("version")).union(b.where("symbol = 'A' or i < 60").select("symbol", "i", F.lit(2)))
    return newest_valid(v).groupBy("symbol", "version").agg(F.count("*").alias("n"))


@query("load_contract", """, raw as (select symbol, date, close from bars where i % 37 <> 5), sp as (select symbol, min(date) as a, max(date) as b from raw group by 1),
  alt as (select b.symbol, b.date, b.close + 1 as close, 1 as rank from bars b join sp using (symbol) where b.date between a and sp.b and dayofweek(b.date) between 1 and 5),
  ev as (select symbol, date, close, 0 as rank from raw union all select * from alt), un as (select * from ev qualify row_number() over (partition by symbol, date order by rank) = 1)
  select symbol, date::varchar as date, close, rank from un qualify count(*) over (partition by symbol) >= 600""", bars=True)
def load_contract_query(spark, sf_dir):
    """Raw bars with days left out, filled on business days from an alternate source whose closes are one higher."""
    b = bars(spark, sf_dir).select("symbol", "date", "close", "i")
    raw = b.where("i % 37 <> 5").drop("i")
    alt = b.select("symbol", "date", (F.col("close") + 1).alias("close"), F.lit(1).alias("rank"))
    return load_contract(raw, alt).withColumn("date", F.col("date").cast("string"))


#: Names of a symbol at three sources: a table that people keep.
SYMBOLS = [("A", "1.000300", "000300.SS", "^shi"), ("N", "0.399001", "399001.SZ", "^szi"), ("R", "1.000001", "000001.SS", "^shc")]


@query("symbol_dictionary", "select l.symbol, n, source, name from (select symbol, count(*) as n from bars group by 1) l join (select * from (values " + ", ".join(f"('{a}', 'one', '{b}'), ('{a}', 'two', '{c}'), ('{a}', 'three', '{d}')" for a, b, c, d in SYMBOLS) + ") v(symbol, source, name)) using (symbol)", bars=True)
def symbol_dictionary(spark, sf_dir):
    """Each series with its names at the sources."""
    d = spark.createDataFrame(SYMBOLS, "symbol string, one string, two string, three string")
    d = d.select("symbol", F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("name")) for c in ("one", "two", "three")])).alias("x")).select("symbol", "x.*")
    return bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n")).join(F.broadcast(d), "symbol").select("symbol", "n", "source", "name")


@query("fetch_results", "select symbol, count(*) >= 600 as ok, count(*) as rows, min(date)::varchar as first, max(date)::varchar as last from bars where symbol <> 'N' group by 1 union all select 'N', false, 0, null, null", bars=True)
def fetch_results(spark, sf_dir):
    """What a batch of fetches brought: one row per wanted symbol, also for those without an answer (here N)."""
    b = bars(spark, sf_dir)
    got = b.where("symbol <> 'N'").groupBy("symbol").agg(F.count("*").alias("rows"), F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last"))
    want = spark.createDataFrame([(s[0],) for s in SYMBOLS], "symbol string")
    return want.join(got, "symbol", "left").select("symbol", F.coalesce(F.col("rows") >= 600, F.lit(False)).alias("ok"), F.coalesce("rows", F.lit(0)).alias("rows"), "first", "last")


@query("live_sentiment", "select event_type, count(*) as n, round(avg(value), 4) as score, case when avg(value) <= 20 then 'fear' when avg(value) >= 85 then 'greed' else 'neutral' end as zone from events group by 1")
def live_sentiment(spark, sf_dir):
    """A score from outside as JSON, and its zone."""
    raw = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_type", F.col("value").alias("score"))).alias("body"))
    x = raw.select(F.from_json("body", "event_type string, score double").alias("d")).select("d.*").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("score").alias("s"))
    return x.select("event_type", "n", F.round("s", 4).alias("score"), F.expr("case when s <= 20 then 'fear' when s >= 85 then 'greed' else 'neutral' end").alias("zone"))
