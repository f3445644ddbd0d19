"""Isotonic regression by pooling adjacent violators, in parts that merge.

Pooling gives the same pools however a sorted sequence is cut, as the pools of each part can be pooled again in order. So values
are summed by x (on the map side first), dealt out by ranges of x, pooled within each range as they stream by, and only
the pools of the ranges, a few dozen each where the data rise at all, go through one last state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recursions import fold


class Pools:
    """A stack of pools (lo, hi, n, sum) with rising means."""

    def __init__(self):
        self.stack: list[list] = []

    def take(self, r) -> list[tuple]:
        self.stack.append([r.lo, r.hi, r.n, r.total])
        while len(self.stack) > 1 and self.stack[-1][3] * self.stack[-2][2] < self.stack[-2][3] * self.stack[-1][2]:
            _, hi, n, total = self.stack.pop()
            last = self.stack[-1]
            last[1:] = [hi, last[2] + n, last[3] + total]
        return []

    def rest(self) -> list[tuple]:
        return [tuple(x) for x in self.stack]


def _range_pools(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pools of the rows of a sorted partition, key by key."""
    names, one, symbol = ["symbol", "lo", "hi", "n", "total"], None, None
    for p in batches:
        done = []
        for r in p.itertuples(index=False):
            if one is None or r.symbol != symbol:
                done += [(symbol, *x) for x in one.rest()] if one else []
                one, symbol = Pools(), r.symbol
            one.take(r)
        yield pd.DataFrame(done, columns=names)
    if one:
        yield pd.DataFrame([(symbol, *x) for x in one.rest()], columns=names)


def pools(samples: DataFrame, x: Column, y: Column) -> DataFrame:
    """symbol, no, lo, hi, n, value: the steps of the isotonic regression of y on x for each symbol. Rows whose x or y is null are
    left out; equal x have one value."""
    sums = samples.select("symbol", x.cast("double").alias("lo"), y.cast("double").alias("y")).where("lo is not null and y is not null").groupBy("symbol", "lo").agg(F.count("*").alias("n"), F.sum("y").alias("total"))
    parts = sums.select("symbol", "lo", F.col("lo").alias("hi"), "n", "total").repartitionByRange("symbol", "lo").sortWithinPartitions("symbol", "lo")
    parts = parts.mapInPandas(_range_pools, "symbol string, lo double, hi double, n long, total double")
    return fold(parts, Pools, "lo", "lo double, hi double, n long, total double").select("symbol", "no", "lo", "hi", "n", (F.col("total") / F.col("n")).alias("value"))


def looked_up(rows: DataFrame, x: str, steps: DataFrame, out: str) -> DataFrame:
    """Adds the value of the step that x lies in; the first or last step's beyond the ends; x itself between two steps. By one
    sorted union of rows and steps, no range join."""
    one = rows.withColumns({"_x": F.col(x).cast("double"), "_s": F.lit(1), "_step": F.lit(None).cast("struct<hi:double,value:double>")})
    two = steps.select("symbol", F.col("lo").alias("_x"), F.lit(0).alias("_s"), F.struct("hi", "value").alias("_step"))
    w = Window.partitionBy("symbol").orderBy("_x", "_s")
    both = one.unionByName(two, allowMissingColumns=True)
    both = both.withColumns({"_at": F.last("_step", True).over(w), "_after": F.first("_step", True).over(w.rowsBetween(1, Window.unboundedFollowing))}).where("_s = 1")
    value = F.when(F.col("_at").isNull(), F.col("_after.value")).when((F.col("_x") <= F.col("_at.hi")) | F.col("_after").isNull(), F.col("_at.value")).otherwise(F.col("_x"))
    return both.select(*rows.columns, value.alias(out))
