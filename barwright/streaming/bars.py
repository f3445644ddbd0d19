"""Streaming twins: tick bars with a watermark, the zigzag as keyed state, and a log upsert that repeated batches do not change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "i long, trend int, low double, low_i long, high double, high_i long, ext double, ext_i long"


def streaming_tick_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """OHLCV bars of a tick stream; ticks later than the watermark are dropped."""
    at = F.struct("ts", "event_id")
    kind = ticks.schema["ts"].dataType  # a watermark needs a timestamp with time zone
    g = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
    g = g.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"))
    return g.select("symbol", F.col("w.start").cast(kind).alias("start"), "open", "high", "low", "close", "volume")


def streaming_zigzag(stream: DataFrame, pct: float) -> DataFrame:
    """Confirmed zigzag pivots of a stream of bars (symbol, i, high, low): the batch result without its pending pivot. A bar that
    comes after a later one, or again, cannot change what was confirmed; it is given back with type `late` and its high."""
    from ..operators.waves import Zigzag

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(frames)).sort_values("i")
        z, seen, out = None, -1, []
        if state.exists:
            seen, trend, low, low_i, high, high_i, ext, ext_i = state.get
            z = Zigzag(pct, 0, 0.0, 0.0)
            z.trend, z.low, z.high, z.extreme = trend, (low, low_i), (high, high_i), (ext, ext_i)
        for i, high, low in zip(bars.i.tolist(), bars.high.tolist(), bars.low.tolist()):
            if i <= seen:
                out.append((key[0], i, high, "late"))
                continue
            seen = i
            if z is None:
                z = Zigzag(pct, i, high, low)
            elif p := z.step(i, high, low):
                out.append((key[0], p[1], p[0], p[2]))
        if z is not None:
            state.update((seen, z.trend, *z.low, *z.high, *z.extreme))
        yield pd.DataFrame(out, columns=["symbol", "i", "price", "type"])

    return stream.groupBy("symbol").applyInPandasWithState(step, "symbol string, i long, price double, type string", STATE, "append", "NoTimeout")


def upsert_batches(path: str, keys: tuple[str, ...]):
    """A foreachBatch sink that appends only rows whose key the log does not have; a repeated batch adds nothing. Of rows of one
    batch with one key, the one that sorts first by its other columns is taken. One writer at a time: two would not see each
    other's rows."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys] or list(keys)
        new = batch.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))).where("_k = 1").drop("_k")
        try:
            new = new.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
        except Exception as e:  # the first batch finds no log
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(path)

    return sink
