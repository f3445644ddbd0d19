"""Registry of named queries: a Spark function and, where SQL can say it, the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Canonical bars from lineitem (one symbol per return flag): a walk of centred daily discounts. All sums are over
#: integers, so both engines agree to the last digit.
BARS_SQL = """
d0 as (select l_returnflag as symbol, cast(l_shipdate as date) as date, count(*) as n,
  sum(cast(round(l_discount * 100) as bigint))::double as disc, sum(cast(round(l_tax * 100) as bigint))::double as tax,
  sum(cast(l_quantity as bigint))::double as volume from lineitem group by 1, 2),
d1 as (select symbol, date, volume, cast(round((disc / 100.0 / n - 0.05) * 0.5 * 1000000.0) as bigint) as micro,
  round(tax / 100.0 / n, 6) as sp from d0),
d2 as (select *, round(3000 * exp(sum(micro) over (partition by symbol order by date) / 1000000.0), 2) as close from d1),
d3 as (select *, coalesce(lag(close) over (partition by symbol order by date), close) as open from d2),
bars as (select symbol, date, (row_number() over (partition by symbol order by date) - 1)::int as i, open,
  round(greatest(open, close) * (1 + sp / 10), 2) as high, round(least(open, close) * (1 - sp / 10), 2) as low, close, volume from d3)
"""


def query(name: str, sql: str | None = None, bars: bool = False):
    """Registers a query; with bars, the SQL continues a WITH list that has `bars` (start it with ", x as" or select)."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"with {BARS_SQL} {sql}" if bars else sql
        return f

    return add
