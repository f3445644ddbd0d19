"""Bar construction: walk bars, tick bars, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walk_bars(lines: DataFrame) -> DataFrame:
    """symbol, date, i, open, high, low, close, volume: a walk of the centred mean discount of each day.

    One shuffle on symbol after a map-side aggregation to days."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double")
    d = lines.groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.count("*").alias("n"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("volume")
    )
    w = Window.partitionBy("symbol").orderBy("date")
    d = d.withColumn("micro", F.round((F.col("disc") / 100.0 / F.col("n") - 0.05) * 0.5 * 1000000.0).cast("long"))
    d = d.withColumn("sp", F.round(F.col("tax") / 100.0 / F.col("n"), 6))
    d = d.withColumn("close", F.round(3000 * F.exp(F.sum("micro").over(w) / 1000000.0), 2))
    d = d.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return d.select("symbol", "date", (F.row_number().over(w) - 1).alias("i"), "open", F.round(top * (1 + F.col("sp") / 10), 2).alias("high"), F.round(bottom * (1 - F.col("sp") / 10), 2).alias("low"), "close", "volume")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk_bars(table(spark, sf_dir, "lineitem"))


def tick_bars(ticks: DataFrame, unit: str = "hour", key: str = "event_type") -> DataFrame:
    """OHLCV bars of ticks (ts, event_id, value)."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy(F.col(key).alias("symbol"), F.date_trunc(unit, "ts").alias("start")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume")
    )


def resample(b: DataFrame, label) -> DataFrame:
    """Coarser bars; label names the period of a date."""
    return b.groupBy("symbol", label.alias("period")).agg(
        F.min_by("open", "i").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "i").alias("close"), F.sum("volume").alias("volume"), F.max("date").alias("last_date")
    )


def friday(date: str):
    """The Friday on or after a date."""
    return F.next_day(F.date_sub(F.col(date), 1), "FRI")


def weekly_closes(b: DataFrame) -> DataFrame:
    """Complete weeks only: symbol, week (its Friday), close, wi."""
    end = b.groupBy("symbol").agg(F.max("date").alias("end"))
    w = b.groupBy("symbol", friday("date").alias("week")).agg(F.max_by("close", "i").alias("close"))
    w = w.join(end, "symbol").where("week <= end").drop("end")
    return w.withColumn("wi", F.row_number().over(Window.partitionBy("symbol").orderBy("week")) - 1)


WEEKS_SQL = """, we as (select symbol, cast(date + ((12 - dayofweek(date)) % 7)::int as date) as week, arg_max(close, i) as close from bars group by 1, 2),
weeks as (select we.symbol, week, close, (row_number() over (partition by we.symbol order by week) - 1)::int as wi
  from we join (select symbol, max(date) as e from bars group by 1) m on m.symbol = we.symbol where week <= e) """


@query("bars_daily_walk", "select symbol, cast(date as varchar) as date, i, open, high, low, close, volume from bars", bars=True)
def bars_daily_walk(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("date", F.col("date").cast("string"))


@query("bars_hourly_events", """select event_type as symbol, date_trunc('hour', ts) as start, arg_min(value, (ts, event_id)) as open, max(value) as high,
  min(value) as low, arg_max(value, (ts, event_id)) as close, count(*) as volume from events group by 1, 2""")
def bars_hourly_events(spark, sf_dir):
    return tick_bars(table(spark, sf_dir, "events"))


@query("bars_weekly_fri", WEEKS_SQL + "select symbol, cast(week as varchar) as week, close, wi from weeks", bars=True)
def bars_weekly_fri(spark, sf_dir):
    return weekly_closes(bars(spark, sf_dir)).select("symbol", F.col("week").cast("string").alias("week"), "close", "wi")


@query("bars_monthly", """select symbol, date_trunc('month', date)::date::varchar as period, arg_min(open, i) as open, max(high) as high, min(low) as low,
  arg_max(close, i) as close, sum(volume) as volume, max(date)::varchar as last_date from bars group by 1, 2""", bars=True)
def bars_monthly(spark, sf_dir):
    return resample(bars(spark, sf_dir), F.trunc("date", "month").cast("string")).withColumn("last_date", F.col("last_date").cast("string"))


@query("calendar_ratio", "select symbol, round(datediff('day', min(date), max(date)) / (count(*) - 1)::double, 6) as ratio from bars group by 1", bars=True)
def calendar_ratio(spark, sf_dir):
    return bars(spark, sf_dir).groupBy("symbol").agg(F.round(F.datediff(F.max("date"), F.min("date")) / (F.count("*") - 1), 6).alias("ratio"))
