"""Recursions over long series without one task for a series: exponential means by blocks, and small states over sorted rows.

An exponential mean maps the value before a block of rows to the value after it by an affine map, y -> a y + c, and such
maps compose; a is the product of all decays so far, so after some hundred rows it is below the rounding of a double, and
the composed map is that of those rows alone. So each block (symbol, i div B) is computed by itself, from its own rows and
the warm-up rows just before it whose maps still count: one shuffle, no join, no Python, and a long series is many tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: exp(-NOUGHT) times a value is below its rounding; exp(LARGEST) is far from overflow.
NOUGHT, LARGEST = 40.0, 600.0


def exponential(rows: DataFrame, means: dict[str, tuple], block: int | None = None) -> DataFrame:
    """Adds columns of exponential means to rows (symbol, i, ...). means: out -> (column, alpha) or (column, alpha, seed).

    y = y + alpha (x - y) over the values x that are not null, in order of i; it begins at the first of them, or at the column
    `seed` (one value a symbol), from which the first value then moves it. Null where x is null, or the seed. The warm-up is
    twice as long as needed, so half its values may be null; after a gap of nulls as long as itself the mean begins anew."""
    decays = [-math.log(1 - m[1]) for m in means.values()]
    warm = 2 * math.ceil(NOUGHT / min(decays))
    block = block or max(1, int(min(4 * warm, LARGEST / max(decays) - warm)))
    if warm + block > LARGEST / max(decays):
        raise ValueError("means whose weights differ this much need passes of their own")
    w = Window.partitionBy("symbol", "_b").orderBy("i")
    own = F.floor(F.col("i") / block)
    x = rows.withColumn("_b", F.explode(F.sequence(own, F.floor((F.col("i") + warm) / block))))
    x = x.withColumns({f"_n_{o}": F.count(m[0]).over(w) for o, m in means.items()})
    # scaled by the decays so far, the mean's weighted sum is a running sum
    x = x.withColumns({f"_s_{o}": F.sum(F.col(m[0]) * F.pow(F.lit(1 / (1 - m[1])), F.col(f"_n_{o}"))).over(w) for o, m in means.items()})
    start = {o: F.first(m[0], ignorenulls=True).over(w) for o, m in means.items()}
    start |= {o: F.when(F.col("_b") * block - warm <= 0, F.col(m[2])).otherwise(start[o]) for o, m in means.items() if len(m) > 2}
    x = x.withColumns({f"_y_{o}": y for o, y in start.items()}).where(F.col("_b") == own)
    value = lambda o, m: F.when(F.col(m[0]).isNotNull(), F.pow(F.lit(1 - m[1]), F.col(f"_n_{o}")) * (F.col(f"_y_{o}") + m[1] * F.col(f"_s_{o}")))
    return x.select(*[F.col(f"`{c}`") for c in rows.columns], *[value(o, m).alias(o) for o, m in means.items()])


def fold(rows: DataFrame, state, order: str, columns: str) -> DataFrame:
    """(symbol, no, columns) of the rows that a new state per symbol gives back, in order. The rows of a symbol pass through its
    state one by one, sorted by Spark and in batches of any size, so a task holds a state and never a series."""
    names = ["symbol", "no", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, symbol, n, out = None, None, 0, []

        def give(found) -> None:
            nonlocal n
            for x in found:
                out.append((symbol, n, *x))
                n += 1

        for p in batches:
            for row in p.itertuples(index=False):
                if one is None or row.symbol != symbol:
                    if one is not None:
                        give(one.rest())
                    one, symbol, n = state(), row.symbol, 0
                give(one.take(row))
            yield pd.DataFrame(out, columns=names)
            out.clear()
        if one is not None:
            give(one.rest())
            yield pd.DataFrame(out, columns=names)

    sort = rows.repartition("symbol").sortWithinPartitions("symbol", order)
    return sort.mapInPandas(run, f"symbol string, no int, {columns}")
