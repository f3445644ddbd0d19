"""Column helpers: guarded windows, clamps, rounding, normal distribution, first passage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("symbol",)


def by(keys=KEYS, order: str = "i"):
    """The one window specification of a bar table; an empty key would put all rows into one task and is refused."""
    if not keys:
        raise ValueError("a window needs at least one key")
    return Window.partitionBy(*keys).orderBy(order)


def last(n: int, keys=KEYS, order: str = "i"):
    return by(keys, order).rowsBetween(-(n - 1), 0)


def full(value: Column, x: Column, n: int, w) -> Column:
    """value where the frame holds n values of x, else null."""
    return F.when(F.count(x).over(w) == n, value)


def mean(x, n: int, keys=KEYS) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return full(F.avg(x).over(last(n, keys)), x, n, last(n, keys))


def std(x, n: int, keys=KEYS) -> Column:
    """Sample standard deviation of n values."""
    x = F.col(x) if isinstance(x, str) else x
    return full(F.stddev_samp(x).over(last(n, keys)), x, n, last(n, keys))


def lag(x: str, n: int = 1, keys=KEYS) -> Column:
    return F.lag(x, n).over(by(keys))


def lead(x: str, n: int = 1, keys=KEYS) -> Column:
    return F.lead(x, n).over(by(keys))


def r6(x: Column) -> Column:
    """Published doubles: six places, no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def with_total(x: DataFrame, sets: list[list[str]], *aggs: Column) -> DataFrame:
    """x aggregated by grouping sets and over all. As in SQL, the total has a row even where x has none, which Spark's grouping
    sets leave out: the aggregates of no rows join in, and give way to a total that is there."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    some = x.groupingSets([*sets, []], *keys).agg(F.grouping_id().alias("set_"), F.struct(*aggs).alias("got_")).withColumn("there_", F.lit(1))
    none = x.limit(0).agg(F.struct(*aggs).alias("got_"))  # one row, without reading x
    none = none.select(*[F.lit(None).cast(x.schema[k].dataType).alias(k) for k in keys], F.lit(2 ** len(keys) - 1).cast("long").alias("set_"), "got_", F.lit(0).alias("there_"))
    return some.unionByName(none).groupBy(*keys, "set_").agg(F.max_by("got_", "there_").alias("got_")).select(*keys, "got_.*")


def finite(x: Column, default: float) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


# Coefficients of Abramowitz and Stegun 26.2.17 (error below 7.5e-8).
_P, _B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf_sql(x: str) -> str:
    """The normal distribution function as SQL that Spark and DuckDB both read."""
    t = f"(1.0e0 / (1.0e0 + {_P}e0 * abs({x})))"
    poly = f"{t} * ({_B[0]}e0 + {t} * ({_B[1]}e0 + {t} * ({_B[2]}e0 + {t} * ({_B[3]}e0 + {t} * {_B[4]}e0))))"
    tail = f"exp(-0.5e0 * {x} * {x}) / {math.sqrt(2 * math.pi)!r}e0 * {poly}"
    return f"(case when {x} >= 0 then 1.0e0 - {tail} else {tail} end)"


def first_passage_sql(a: str, mu: str, sigma: str, t: str) -> str:
    """Probability of reaching the log distance a (signed) within t periods of a walk with drift mu and deviation sigma."""
    sv, down = f"({sigma} * sqrt({t}))", f"(case when {a} >= 0 then {mu} else -({mu}) end)"
    d1, d2 = f"((abs({a}) - {down} * {t}) / {sv})", f"((-abs({a}) - {down} * {t}) / {sv})"
    ex = f"exp(greatest(-50.0e0, least(50.0e0, 2.0e0 * {mu} * {a} / ({sigma} * {sigma} + 1e-12))))"
    return f"(case when {t} <= 0 or {sv} <= 0 then 0.5e0 else 1.0e0 - {normal_cdf_sql(d1)} + {ex} * {normal_cdf_sql(d2)} end)"
