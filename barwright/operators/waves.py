"""Pivots, waves and pattern signals.

Zigzag and strokes are true folds (each step depends on the state): the sorted bars of a symbol pass through a small
state; everything that follows works on the small pno tables with windows and joins."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by, with_total
from ..functions.recursions import exponential, fold
from ..plans.registry import query
from ..sources.bars import bars
from .alignment import business_days
from .indicators import ICHIMOKU_SQL, _adx_sql, adx_columns, ichimoku, rsi_columns, sql_ema, sql_last

P = "partition by symbol order by i"
PCT = 0.03


class Zigzag:
    """State of the percentage zigzag; step() takes a bar and returns a pno once it is confirmed."""

    def __init__(self, pct: float, i: int, high: float, low: float):
        self.pct, self.trend = pct, 0
        self.low, self.high = (low, i), (high, i)
        self.extreme = (high, i)

    def step(self, i: int, high: float, low: float):
        if self.trend == 0:
            self.low, self.high = min(self.low, (low, i)), max(self.high, (high, i), key=lambda x: x[0])
            if high >= self.low[0] * (1 + self.pct):
                self.trend, self.extreme = 1, (high, i)
                return (*self.low, "L")
            if low <= self.high[0] * (1 - self.pct):
                self.trend, self.extreme = -1, (low, i)
                return (*self.high, "H")
            return None
        beyond, turned = (high, low <= self.extreme[0] * (1 - self.pct)) if self.trend > 0 else (low, high >= self.extreme[0] * (1 + self.pct))
        if (beyond - self.extreme[0]) * self.trend > 0:
            self.extreme = (beyond, i)
        elif turned:
            pno = (*self.extreme, "H" if self.trend > 0 else "L")
            self.trend, self.extreme = -self.trend, ((low if self.trend > 0 else high), i)
            return pno
        return None

    def pending(self):
        return (*self.extreme, "H" if self.trend > 0 else "L") if self.trend else None


def zigzag_state(pct: float):
    """The zigzag for `fold`: it gives back confirmed pivots, and the pending one at the end."""

    class State:
        z: Zigzag | None = None

        def take(self, b) -> list[tuple]:
            if self.z is None:
                self.z = Zigzag(pct, b.i, b.high, b.low)
                return []
            p = self.z.step(b.i, b.high, b.low)
            return [(p[1], p[0], p[2], False)] if p else []

        def rest(self) -> list[tuple]:
            p = self.z.pending()
            return [(p[1], p[0], p[2], True)] if p else []

    return State


def zigzag(b: DataFrame, pct: float = PCT) -> DataFrame:
    """symbol, pno, i, date, price, type, unconfirmed."""
    z = fold(b.select("symbol", "i", "high", "low"), zigzag_state(pct), "i", "i int, price double, type string, unconfirmed boolean")
    return z.withColumnRenamed("no", "pno").join(b.select("symbol", "i", "date"), ["symbol", "i"])


ZIGZAG_SQL = f"""with recursive {{bars}}, z as (
  select symbol, i, 0 as trend, low as ll, i as li, high as hh, i as hi, high as ext, i as ei, null::double as pp, null::int as pi, null::varchar as pt from bars where i = 0
  union all
  select symbol, i, case when trend = 0 then case when up0 then 1 when dn0 then -1 else 0 end when trend = 1 and not (h > ext) and l <= ext * (1 - {PCT}) then -1 when trend = -1 and not (l < ext) and h >= ext * (1 + {PCT}) then 1 else trend end,
    ll2, li2, hh2, hi2,
    case when trend = 0 then case when up0 then h when dn0 then l else ext end when trend = 1 then case when h > ext then h when l <= ext * (1 - {PCT}) then l else ext end else case when l < ext then l when h >= ext * (1 + {PCT}) then h else ext end end,
    case when trend = 0 then case when up0 or dn0 then i else ei end when trend = 1 then case when h > ext or l <= ext * (1 - {PCT}) then i else ei end else case when l < ext or h >= ext * (1 + {PCT}) then i else ei end end,
    case when trend = 0 and up0 then ll2 when trend = 0 and dn0 then hh2 when trend = 1 and not (h > ext) and l <= ext * (1 - {PCT}) then ext when trend = -1 and not (l < ext) and h >= ext * (1 + {PCT}) then ext end,
    case when trend = 0 and up0 then li2 when trend = 0 and dn0 then hi2 when trend = 1 and not (h > ext) and l <= ext * (1 - {PCT}) then ei when trend = -1 and not (l < ext) and h >= ext * (1 + {PCT}) then ei end,
    case when trend = 0 and up0 then 'L' when trend = 0 and dn0 then 'H' when trend = 1 and not (h > ext) and l <= ext * (1 - {PCT}) then 'H' when trend = -1 and not (l < ext) and h >= ext * (1 + {PCT}) then 'L' end
  from (select *, h >= ll2 * (1 + {PCT}) as up0, l <= hh2 * (1 - {PCT}) as dn0 from (
    select z.symbol, b.i, z.trend, z.ext, z.ei, b.high as h, b.low as l,
      case when z.trend = 0 and b.low < z.ll then b.low else z.ll end as ll2, case when z.trend = 0 and b.low < z.ll then b.i else z.li end as li2,
      case when z.trend = 0 and b.high > z.hh then b.high else z.hh end as hh2, case when z.trend = 0 and b.high > z.hh then b.i else z.hi end as hi2
    from z join bars b on b.symbol = z.symbol and b.i = z.i + 1))),
pv as (select symbol, pi as i, pp as price, pt as type, false as unconfirmed, i as seen from z where pi is not null
  union all select symbol, ei, ext, case when trend = 1 then 'H' else 'L' end, true, 1000000000 from z where trend <> 0 qualify row_number() over (partition by symbol order by i desc) = 1),
piv as (select pv.symbol, (row_number() over (partition by pv.symbol order by seen) - 1)::int as pno, pv.i, date, price, type, unconfirmed from pv join bars using (symbol, i))
"""


def zsql(body: str) -> str:
    from ..plans.registry import BARS_SQL

    return ZIGZAG_SQL.replace("{bars}", BARS_SQL) + body


@query("zigzag", zsql("select symbol, pno, i, date::varchar as date, price, type, unconfirmed from piv"))
def zigzag_query(spark, sf_dir):
    return zigzag(bars(spark, sf_dir)).select("symbol", "pno", "i", F.col("date").cast("string").alias("date"), "price", "type", "unconfirmed")


def pw():
    return Window.partitionBy("symbol").orderBy("pno")


#: Business days that a leg of a five-wave run has at least.
RUN_LEG = 12


def legs(z: DataFrame, least: int = 10) -> DataFrame:
    """Legs between consecutive pivots of at least so many business days: signed log return and length."""
    x = z.withColumns({"p1": F.lead("price").over(pw()), "d1": F.lead("date").over(pw())}).where("p1 is not null")
    return x.withColumns({"ret": F.ln(F.col("p1") / F.col("price")), "days": business_days(F.col("date"), F.col("d1"))}).where(F.col("days") >= least)


LEGS = """, lg0 as (select *, lead(price) over w as p1, lead(date) over w as d1 from piv window w as (partition by symbol order by pno)),
lg1 as (select *, ln(p1 / price) as ret, (select count(*) from generate_series(1, datediff('day', date, d1)) t(k) where dayofweek(date + k::int) between 1 and 5)::int as days from lg0 where p1 is not null),
legs as (select * from lg1 where days >= 10) """


@query("legs", zsql(LEGS + "select symbol, pno, round(ret, 6) as ret, days, date::varchar as d0, d1::varchar as d1 from legs"))
def legs_query(spark, sf_dir):
    x = legs(zigzag(bars(spark, sf_dir)))
    return x.select("symbol", "pno", F.round("ret", 6).alias("ret"), "days", F.col("date").cast("string").alias("d0"), F.col("d1").cast("string").alias("d1"))


def five_wave_runs(l: DataFrame) -> DataFrame:
    """Five legs in a row (of legs that are long enough) with signs + - + - + and a gain of at least 2 percent from the
    first price to the last: v0 to v5 are the turning prices, t0 to t5 their dates. Legs left out leave gaps in between."""
    x = l.withColumns({f"r{k}": F.lead("ret", k).over(pw()) for k in range(1, 5)} | {f"v{k + 1}": F.lead("p1", k).over(pw()) for k in range(5)} | {f"t{k + 1}": F.lead("d1", k).over(pw()) for k in range(5)})
    x = x.withColumns({"v0": F.col("price"), "t0": F.col("date")})
    return x.where("ret > 0 and r1 < 0 and r2 > 0 and r3 < 0 and r4 > 0 and (v5 - v0) / v0 >= 0.02")


RUNS = LEGS + f""", lr as (select *, price as v0, date as t0, lead(ret, 1) over w as r1, lead(ret, 2) over w as r2, lead(ret, 3) over w as r3, lead(ret, 4) over w as r4, {', '.join(f'lead(p1, {k}) over w as v{k + 1}, lead(d1, {k}) over w as t{k + 1}' for k in range(5))} from lg1 where days >= {RUN_LEG} window w as (partition by symbol order by pno)),
runs as (select * from lr where ret > 0 and r1 < 0 and r2 > 0 and r3 < 0 and r4 > 0 and (v5 - v0) / v0 >= 0.02) """


@query("five_wave_runs", zsql(RUNS + "select symbol, pno, round(v5 / v0 - 1, 6) as net from runs"))
def five_wave_runs_query(spark, sf_dir):
    return five_wave_runs(legs(zigzag(bars(spark, sf_dir)), RUN_LEG)).select("symbol", "pno", F.round(F.col("v5") / F.col("v0") - 1, 6).alias("net"))


#: Ratios of the waves in a run: 2 to 1, 3 to 1, 4 to 3, 5 to 1; what counts as sane.
RUN_RATIOS = {"q2": "(v1 - v2) / (v1 - v0)", "q3": "(v3 - v2) / (v1 - v0)", "q4": "(v3 - v4) / (v3 - v2)", "q5": "(v5 - v4) / (v1 - v0)"}
SANE = "v1 > v0 and v1 > v2 and v3 > v2 and v3 > v4 and q2 between 0.2e0 and 0.7e0 and q3 between 1e0 and 2.2e0 and q4 between 0.2e0 and 0.6e0"
_RQ = ", ".join(f"{v} as {k}" for k, v in RUN_RATIOS.items())


def run_ratios(runs: DataFrame) -> DataFrame:
    """Medians of the sane runs' ratios per symbol and over all (symbol null); null where fewer than six runs are sane."""
    x = runs.withColumns({k: F.expr(v) for k, v in RUN_RATIOS.items()}).withColumn("sane", F.expr(SANE))
    m = lambda c: F.when(F.count_if("sane") >= 6, F.round(F.median(F.when(F.col("sane"), F.col(c))), 4)).alias(c)
    return with_total(x, [["symbol"]], F.count("*").alias("n"), F.count_if("sane").alias("sane_n"), m("q2"), m("q3"), m("q4"))


RATIO_SQL = f""", rq as (select *, {SANE} as sane from (select *, {_RQ} from runs)),
rr as (select symbol, count(*) as n, count(*) filter (sane) as sane_n, {', '.join(f"case when count(*) filter (sane) >= 6 then round(median({c}) filter (sane), 4) end as {c}" for c in ("q2", "q3", "q4"))} from rq group by grouping sets ((symbol), ())) """


@query("subwave_ratios", zsql(RUNS + RATIO_SQL + "select * from rr"))
def subwave_ratios(spark, sf_dir):
    return run_ratios(five_wave_runs(legs(zigzag(bars(spark, sf_dir)), RUN_LEG)))


RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)


def last_swing(z: DataFrame) -> DataFrame:
    """Per symbol, the high and low of its last confirmed leg."""
    x = z.where("not unconfirmed").withColumns({"k": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("pno"))), "p0": F.lag("price").over(pw())}).where("k = 1 and p0 is not null")
    return x.select("symbol", F.greatest("price", "p0").alias("hi"), F.least("price", "p0").alias("lo"), F.col("i").alias("pi"), "type")


SWING = ", ls as (select symbol, greatest(price, p0) as hi, least(price, p0) as lo, i as pi, type from (select *, row_number() over (partition by symbol order by pno desc) as k, lag(price) over (partition by symbol order by pno) as p0 from piv where not unconfirmed) where k = 1 and p0 is not null) "


@query("fib_levels", zsql(SWING + "select symbol, ratio::double as ratio, round(hi - (hi - lo) * ratio, 4) as level from ls, (select unnest([0.236, 0.382, 0.5, 0.618, 0.786]) as ratio)"))
def fib_levels(spark, sf_dir):
    s = last_swing(zigzag(bars(spark, sf_dir)))
    return s.select("symbol", "hi", "lo", F.explode(F.array(*[F.lit(x) for x in RATIOS])).alias("ratio")).select("symbol", "ratio", F.round(F.col("hi") - (F.col("hi") - F.col("lo")) * F.col("ratio"), 4).alias("level"))


@query("wave_targets", zsql(SWING + "select symbol, k::double as k, round(case when type = 'H' then lo + (hi - lo) * k else hi - (hi - lo) * k end, 4) as target from ls, (select unnest([1.0, 1.272, 1.618]) as k)"))
def wave_targets(spark, sf_dir):
    """Extensions of the last leg in its own direction."""
    s = last_swing(zigzag(bars(spark, sf_dir))).withColumn("k", F.explode(F.array(F.lit(1.0), F.lit(1.272), F.lit(1.618))))
    return s.select("symbol", "k", F.round(F.expr("case when type = 'H' then lo + (hi - lo) * k else hi - (hi - lo) * k end"), 4).alias("target"))


@query("level_distances", zsql(SWING + ", lc as (select symbol, arg_max(close, i) as c from bars group by 1) select symbol, ratio::double as ratio, round(((hi - (hi - lo) * ratio) / c - 1) * 100, 4) + 0.0 as pct from ls join lc using (symbol), (select unnest([0.236, 0.382, 0.5, 0.618, 0.786]) as ratio)"))
def level_distances(spark, sf_dir):
    b = bars(spark, sf_dir)
    s = last_swing(zigzag(b)).join(b.groupBy("symbol").agg(F.max_by("close", "i").alias("c")), "symbol").withColumn("ratio", F.explode(F.array(*[F.lit(x) for x in RATIOS])))
    return s.select("symbol", "ratio", (F.round(((F.col("hi") - (F.col("hi") - F.col("lo")) * F.col("ratio")) / F.col("c") - 1) * 100, 4) + 0.0).alias("pct"))


@query("wave_channel", zsql(""", ch as (select *, lead(price, 2) over w as p2, lead(i, 2) over w as i2, lead(price, 1) over w as p1, lead(i, 1) over w as i1 from piv window w as (partition by symbol order by pno))
  select symbol, pno, round((p2 - price) / (i2 - i), 6) + 0.0 as slope, round(p1 - (price + (p2 - price) / (i2 - i) * (i1 - i)), 4) + 0.0 as width from ch where p2 is not null and i2 > i"""))
def wave_channel(spark, sf_dir):
    """The line through every other pno, and the parallel through the one between."""
    c = zigzag(bars(spark, sf_dir)).withColumns({"p2": F.lead("price", 2).over(pw()), "i2": F.lead("i", 2).over(pw()), "p1": F.lead("price").over(pw()), "i1": F.lead("i").over(pw())}).where("p2 is not null and i2 > i")
    slope = (F.col("p2") - F.col("price")) / (F.col("i2") - F.col("i"))
    return c.select("symbol", "pno", (F.round(slope, 6) + 0.0).alias("slope"), (F.round(F.col("p1") - (F.col("price") + slope * (F.col("i1") - F.col("i"))), 4) + 0.0).alias("width"))


@query("volume_by_wave", zsql(", w as (select *, lead(i) over (partition by symbol order by pno) as e from piv) select w.symbol, w.pno, count(*) as n, round(avg(volume), 6) as volume from w join bars b on b.symbol = w.symbol and b.i > w.i and b.i <= w.e group by 1, 2"))
def volume_by_wave(spark, sf_dir):
    """Mean volume between turning points: bars take their wave by a forward fill, not by a range join."""
    b = bars(spark, sf_dir)
    # two pivots may lie on one bar; the later one opens the wave
    z = zigzag(b).groupBy("symbol", "i").agg(F.max("pno").alias("pno"))
    x = b.select("symbol", "i", "volume").join(z, ["symbol", "i"], "left")
    wave = F.last("pno", ignorenulls=True).over(by().rowsBetween(-(2**31) + 1, -1))
    end = F.max("pno").over(Window.partitionBy("symbol"))
    x = x.withColumns({"w": wave, "end": end}).where("w is not null and w < end")
    return x.groupBy("symbol", F.col("w").alias("pno")).agg(F.count("*").alias("n"), F.round(F.avg("volume"), 6).alias("volume"))


@query("fib_time_zones", zsql(SWING + ", lb as (select symbol, max(i) as mi, max(date) as md, datediff('day', min(date), max(date)) / (count(*) - 1)::double as ratio from bars group by 1) select symbol, k::int as k, coalesce(b.date, md + round((pi + k - mi) * ratio)::int)::varchar as date from ls join lb using (symbol) cross join (select unnest([13, 21, 34, 55, 89, 144, 233, 377, 610]) as k) left join bars b using (symbol) where b.i = pi + k or (b.i = 0 and pi + k > mi)".replace("coalesce(b.date,", "coalesce(case when b.i = pi + k then b.date end,")))
def fib_time_zones(spark, sf_dir):
    """Dates that lie Fibonacci numbers of bars after the last pno; beyond the data by the calendar ratio."""
    b = bars(spark, sf_dir)
    end = b.groupBy("symbol").agg(F.max("i").alias("mi"), F.max("date").alias("md"), (F.datediff(F.max("date"), F.min("date")) / (F.count("*") - 1)).alias("ratio"))
    z = last_swing(zigzag(b)).join(end, "symbol").withColumn("k", F.explode(F.array(*[F.lit(x) for x in (13, 21, 34, 55, 89, 144, 233, 377, 610)])))
    z = z.withColumn("i", F.col("pi") + F.col("k")).join(b.select("symbol", "i", "date"), ["symbol", "i"], "left")
    later = F.date_add("md", F.round((F.col("i") - F.col("mi")) * F.col("ratio")).cast("int"))
    return z.select("symbol", "k", F.coalesce("date", later).cast("string").alias("date"))


@query("horizon_estimate", zsql(LEGS + """, t as (select symbol, m::double as m, ln(1 + m) as need from (select distinct symbol from bars), (select unnest([-0.12, -0.06, -0.03, 0.03, 0.06, 0.12]) as m)),
  c as (select t.symbol, t.m, days * (abs(need) / abs(l.ret)) as days, row_number() over (partition by t.symbol, m order by days * (abs(need) / abs(l.ret)), pno) as k, count(*) over (partition by t.symbol, m) as n from t join legs l on l.symbol = t.symbol and sign(l.ret) = sign(need) and abs(l.ret) >= abs(need)),
  u as (select symbol, m, max(days) filter (k = n // 2 + 1) as med, any_value(n) as n from c group by 1, 2),
  near as (select t.symbol, t.m, avg(ttr) as mean from t join lateral (select l.days * (abs(need) / abs(l.ret)) as ttr from legs l where l.symbol = t.symbol and sign(l.ret) = sign(need) order by abs(abs(l.ret) - abs(need)), pno limit 5) on true group by 1, 2)
  select t.symbol, t.m, greatest(10, least(330, round_even(coalesce(case when n >= 4 then med else mean end, 330), 0)))::int as bars from t left join u using (symbol, m) left join near using (symbol, m)"""))
def horizon_estimate(spark, sf_dir):
    """Bars to targets of several distances."""
    b = bars(spark, sf_dir)
    t = b.select("symbol").distinct().withColumn("m", F.explode(F.array(*[F.lit(x) for x in (-0.12, -0.06, -0.03, 0.03, 0.06, 0.12)]))).withColumn("need", F.log1p("m"))
    return time_to_reach(t, legs(zigzag(b)), ["m"]).select("symbol", "m", "bars")


def time_to_reach(t: DataFrame, l: DataFrame, keys: list[str]) -> DataFrame:
    """Adds bars: how long a move of `need` (a log distance) takes. A leg of that direction reaches it after its own length
    times need over its size; the upper median over legs that are large enough (4 at least), else the mean over the 5
    that are nearest in size, 330 where there is none; from 10 to 330."""
    own = ["symbol", *keys]
    l = l.select(F.col("symbol").alias("ls"), "pno", "ret", F.col("days").alias("leg_days"))
    j = t.join(l, (F.col("symbol") == F.col("ls")) & (F.signum("ret") == F.signum("need"))).withColumn("ttr", F.col("leg_days") * (F.abs("need") / F.abs("ret")))
    big = j.where("abs(ret) >= abs(need)").groupBy(*own).agg(F.array_sort(F.collect_list("ttr")).alias("d")).select(*own, F.size("d").alias("n_"), F.expr("d[size(d) div 2]").alias("med_"))
    k = F.row_number().over(Window.partitionBy(*own).orderBy(F.abs(F.abs("ret") - F.abs("need")), "pno"))
    near = j.withColumn("k_", k).where("k_ <= 5").groupBy(*own).agg(F.avg("ttr").alias("mean_"))
    x = t.join(big, own, "left").join(near, own, "left")
    return x.withColumn("bars", F.greatest(F.lit(10), F.least(F.lit(330), F.bround(F.coalesce(F.when(F.col("n_") >= 4, F.col("med_")).otherwise(F.col("mean_")), F.lit(330.0))))).cast("int")).drop("n_", "med_", "mean_")


# ------------------------------------------------------------------------------------------- swings and patterns
def swings(b: DataFrame, w: int = 5, both: bool = False) -> DataFrame:
    """Alternating swing points: centred extremes, runs of one type reduced to their (first) extreme. Bars that are both a high
    and a low are dropped or, with `both`, are a high and then a low."""
    f = by().rowsBetween(-w, w)
    x = b.withColumns({"mx": F.max("high").over(f), "mn": F.min("low").over(f), "n": F.count("*").over(f)})
    x = x.withColumns({"h": F.expr(f"n >= {w + 1} and high = mx"), "l": F.expr(f"n >= {w + 1} and low = mn")}).where("h or l" if both else "h <> l")
    point = lambda on, kind, c: F.when(F.col(on), F.struct(F.lit(kind).alias("type"), F.col(c).alias("price")))
    x = x.select("symbol", "i", F.explode(F.array_compact(F.array(point("h", "H", "high"), point("l", "L", "low")))).alias("x")).select("symbol", "i", "x.type", "x.price")
    o = Window.partitionBy("symbol").orderBy("i", "type")
    new = F.coalesce((F.col("type") != F.lag("type").over(o)).cast("int"), F.lit(0))
    x = x.withColumn("new", new).withColumn("run", F.sum("new").over(o))
    best = F.max_by(F.struct("i", "price"), F.struct(F.when(F.col("type") == "H", F.col("price")).otherwise(-F.col("price")), -F.col("i")))
    x = x.groupBy("symbol", "run", "type").agg(best.alias("b"))
    return x.select("symbol", F.col("run").cast("int").alias("pno"), "b.i", "b.price", "type")


SWINGS = f""", s0 as (select symbol, i, high, low, max(high) over f as mx, min(low) over f as mn, count(*) over f as n from bars window f as ({P} rows between 5 preceding and 5 following)),
s1 as (select symbol, i, case when high = mx then 'H' else 'L' end as type, case when high = mx then high else low end as price from s0 where n >= 6 and (high = mx) <> (low = mn)),
s2 as (select *, coalesce((type <> lag(type) over ({P}))::int, 0) as new from s1), s3 as (select *, sum(new) over ({P}) as run from s2),
sw as (select symbol, run::int as pno, arg_max(i, (case when type = 'H' then price else -price end, -i)) as i, case when type = 'H' then max(price) else min(price) end as price, type from s3 group by symbol, run, type) """


@query("swings_alternating", SWINGS + "select symbol, pno, i, price, type from sw", bars=True)
def swings_alternating(spark, sf_dir):
    return swings(bars(spark, sf_dir)).select("symbol", "pno", "i", "price", "type")


BOTH_SWINGS = SWINGS.replace("5 preceding and 5 following", "10 preceding and 10 following").replace("""select symbol, i, case when high = mx then 'H' else 'L' end as type, case when high = mx then high else low end as price from s0 where n >= 6 and (high = mx) <> (low = mn)""",
  """select symbol, i, 'H' as type, high as price from s0 where n >= 11 and high = mx union all select symbol, i, 'L', low from s0 where n >= 11 and low = mn""").replace(f"({P})::int, 0) as new", "(partition by symbol order by i, type))::int, 0) as new").replace(f"lag(type) over ({P})", "lag(type) over (partition by symbol order by i, type)").replace(f"sum(new) over ({P})", "sum(new) over (partition by symbol order by i, type)")


@query("swings_both", BOTH_SWINGS + "select symbol, pno, i, price, type from sw", bars=True)
def swings_both(spark, sf_dir):
    return swings(bars(spark, sf_dir), 10, both=True).select("symbol", "pno", "i", "price", "type")


SIX = ", ".join(f"lead(price, {k}) over w as p{k}, lead(i, {k}) over w as i{k}" for k in range(1, 6))
#: Waves 1 to 5 in units of the impulse direction u (1 up, -1 down); rules, Fibonacci ranges with tolerance, lengths.
LEN = {1: "(p1 - price) * u", 2: "(p1 - p2) * u", 3: "(p3 - p2) * u", 4: "(p3 - p4) * u", 5: "(p5 - p4) * u"}
IMPULSE = f"""p5 is not null and {LEN[1]} > 0 and {LEN[3]} > 0 and (p2 - price) * u > 0 and (p4 - p1) * u > 0
  and not ({LEN[3]} < {LEN[1]} and {LEN[3]} < {LEN[5]}) and {LEN[2]} / ({LEN[1]}) between 0.4 and 0.718 and {LEN[3]} / ({LEN[1]}) between 0.9 and 2.718
  and {LEN[4]} / ({LEN[3]}) between 0.136 and 0.6 and i1 - i >= 4 and i2 - i1 >= 4 and i3 - i2 >= 4 and i4 - i3 >= 4 and i5 - i4 >= 4"""


def impulses(s: DataFrame) -> DataFrame:
    x = s.withColumns({f"{c[0]}{k}": F.lead(c, k).over(pw()) for k in range(1, 6) for c in ("price", "i")})
    return x.withColumn("u", F.when(F.col("type") == "L", 1).otherwise(-1)).where(IMPULSE)


@query("sig_elliott_impulse", SWINGS + f", x as (select *, case when type = 'L' then 1 else -1 end as u, {SIX} from sw window w as (partition by symbol order by pno)) select symbol, i5 as i, -u as signal from x where {IMPULSE}", bars=True)
def sig_elliott_impulse(spark, sf_dir):
    """After five complete waves, a signal against the impulse."""
    return impulses(swings(bars(spark, sf_dir))).select("symbol", F.col("i5").alias("i"), (-F.col("u")).alias("signal"))


ABC = "p3 is not null and (p1 - price) * u > 0 and (p2 - price) * u > 0 and (p3 - p1) * u > 0 and (p1 - p2) / (p1 - price) between 0.282 and 0.886 and (p3 - p2) / (p1 - price) between 0.518 and 1.718"


@query("sig_elliott_abc", SWINGS + f""", x as (select *, case when type = 'L' then 1 else -1 end as u, {SIX} from sw window w as (partition by symbol order by pno)),
  imp as (select symbol, i as a, i5 as b from x where {IMPULSE}) select symbol, i3 as i, -u as signal from x where {ABC} and not exists (select 1 from imp where imp.symbol = x.symbol and x.i >= imp.a and x.i3 <= imp.b)""", bars=True)
def sig_elliott_abc(spark, sf_dir):
    """Three corrective waves outside of impulses; a signal against the correction."""
    s = swings(bars(spark, sf_dir))
    imp = impulses(s).select("symbol", F.col("i").alias("a"), F.col("i5").alias("b"))
    x = s.withColumns({f"{c[0]}{k}": F.lead(c, k).over(pw()) for k in range(1, 4) for c in ("price", "i")}).withColumn("u", F.when(F.col("type") == "L", 1).otherwise(-1)).where(ABC)
    inside = (x["symbol"] == imp["symbol"]) & (x["i"] >= imp["a"]) & (x["i3"] <= imp["b"])
    return x.join(imp, inside, "left_anti").select("symbol", F.col("i3").alias("i"), (-F.col("u")).alias("signal"))


# Ratio ranges of the harmonic patterns (b = AB/XA, bc = BC/AB, cd = CD/BC, d = AD/XA), first match wins.
HARMONIC = [
    ("gartley", 0.618, 0.618, 0.382, 0.886, 1.13, 1.618, 0.786, 0.786),
    ("bat", 0.382, 0.5, 0.382, 0.886, 1.618, 2.618, 0.886, 0.886),
    ("butterfly", 0.786, 0.786, 0.382, 0.886, 1.618, 2.618, 1.27, 1.618),
    ("crab", 0.382, 0.618, 0.382, 0.886, 2.24, 3.618, 1.618, 1.618),
]
TOL = 0.08
_CLASS = "case " + " ".join(f"when b between {b0 - TOL:.4f} and {b1 + TOL:.4f} and bc between {c0 - TOL:.4f} and {c1 + TOL:.4f} and cd between {d0 - TOL:.4f} and {d1 + TOL:.4f} and d between {e0 - TOL:.4f} and {e1 + TOL:.4f} then '{n}'" for n, b0, b1, c0, c1, d0, d1, e0, e1 in HARMONIC) + " end"
_XABCD = "abs(p2 - p1) / abs(p1 - price) as b, abs(p3 - p2) / abs(p2 - p1) as bc, abs(p4 - p3) / abs(p3 - p2) as cd, abs(p4 - p1) / abs(p1 - price) as d"


@query("sig_harmonic", BOTH_SWINGS + f", x as (select *, {SIX} from sw window w as (partition by symbol order by pno)), y as (select symbol, i4 as i, type, {_XABCD} from x where p4 is not null and p1 <> price and p2 <> p1 and p3 <> p2) select symbol, i, {_CLASS} as pattern, case when type = 'L' then 1 else -1 end as signal from y where {_CLASS} is not null", bars=True)
def sig_harmonic(spark, sf_dir):
    """Five points in a row whose ratios fit a pattern, on swings of ten bars either way."""
    x = swings(bars(spark, sf_dir), 10, both=True).withColumns({f"{c[0]}{k}": F.lead(c, k).over(pw()) for k in range(1, 5) for c in ("price", "i")})
    y = x.where("p4 is not null and p1 <> price and p2 <> p1 and p3 <> p2").selectExpr("symbol", "i4 as i", "type", *_XABCD.split(", "))
    return y.select("symbol", "i", F.expr(_CLASS).alias("pattern"), F.expr("case when type = 'L' then 1 else -1 end").alias("signal")).where("pattern is not null")


@query("fvg", f", x as (select symbol, i, low, high, lag(high, 2) over ({P}) as h2, lag(low, 2) over ({P}) as l2 from bars) select symbol, i, case when low > h2 then 1 when high < l2 then -1 else 0 end as fvg from x", bars=True)
def fvg(spark, sf_dir):
    """Fair-value gaps: the bar leaves a gap to the one before its predecessor."""
    x = bars(spark, sf_dir).withColumns({"h2": F.lag("high", 2).over(by()), "l2": F.lag("low", 2).over(by())})
    return x.select("symbol", "i", F.expr("case when low > h2 then 1 when high < l2 then -1 else 0 end").alias("fvg"))


@query("sig_structure_break", SWINGS + f""", hl as (select b.symbol, b.i, b.close, lag(b.close) over (partition by b.symbol order by b.i) as before, last_value(case when s.type = 'H' then s.price end ignore nulls) over o as h, last_value(case when s.type = 'L' then s.price end ignore nulls) over o as l
  from bars b left join sw s on s.symbol = b.symbol and s.i + 5 = b.i window o as (partition by b.symbol order by b.i))
  select symbol, i, case when close > h and before <= h then 1 when close < l and before >= l then -1 else 0 end as signal from hl where (close > h and before <= h) or (close < l and before >= l)""", bars=True)
def sig_structure_break(spark, sf_dir):
    """Break of structure: the close passes the last swing that was known (swings are known five bars later)."""
    b = bars(spark, sf_dir)
    s = swings(b).select("symbol", (F.col("i") + 5).alias("i"), F.when(F.col("type") == "H", F.col("price")).alias("sh"), F.when(F.col("type") == "L", F.col("price")).alias("sl"))
    w = by().rowsBetween(-(2**31) + 1, 0)
    x = b.join(s, ["symbol", "i"], "left").withColumns({"h": F.last("sh", True).over(w), "l": F.last("sl", True).over(w), "before": F.lag("close").over(by())})
    return x.select("symbol", "i", F.expr("case when close > h and before <= h then 1 when close < l and before >= l then -1 else 0 end").alias("signal")).where("signal <> 0")


@query("sig_ichimoku", f"""{ICHIMOKU_SQL}, s as (select *, lag(tenkan) over ({P}) as t1, lag(kijun) over ({P}) as k1 from ich)
  select symbol, i, case when i < 78 then 0 when tenkan > kijun and t1 <= k1 and close > greatest(span_a, span_b) and span_a > span_b then 1 when tenkan < kijun and t1 >= k1 and close < least(span_a, span_b) and span_a < span_b then -1 else 0 end as signal from s""", bars=True)
def sig_ichimoku(spark, sf_dir):
    """Cross of the two lines, price beyond the cloud, cloud in the same direction; 78 bars of warm-up."""
    s = ichimoku(bars(spark, sf_dir)).withColumns({"t1": F.lag("tenkan").over(by()), "k1": F.lag("kijun").over(by())})
    return s.select("symbol", "i", F.expr("case when i < 78 then 0 when tenkan > kijun and t1 <= k1 and close > greatest(span_a, span_b) and span_a > span_b then 1 when tenkan < kijun and t1 >= k1 and close < least(span_a, span_b) and span_a < span_b then -1 else 0 end").alias("signal"))


_VOTE = _adx_sql() + f""", {sql_ema('close', '(2.0/13)', 'vf', 'bars')}, {sql_ema('close', '(2.0/27)', 'vs', 'bars')}, vm as (select symbol, i, close, volume, close - lag(close) over ({P}) as x from bars),
vu as (select symbol, i, case when x > 0 then x else x * 0 end as u, case when x < 0 then -x else x * 0 end as d from vm), {sql_ema('u', '(1.0/14)', 'va', 'vu')}, {sql_ema('d', '(1.0/14)', 'vb', 'vu')},
vr as (select a.symbol, a.i, case when a.i >= 14 and b.v <> 0 then 100 - 100 / (1 + a.v / b.v) end as rsi from va a join vb b using (symbol, i)),
vw as (select *, sum(volume * coalesce(sign(x), 0)) over ({P}) as flow, {sql_last('avg', 'close', 20)} as m, {sql_last('stddev_samp', 'close', 20)} as s from vm), vx as (select *, {sql_last('avg', 'flow', 20)} as fm from vw),
vv as (select vx.symbol, vx.i, coalesce(((vf.v > vs.v and coalesce(adx, 0) > 25) or coalesce(close < m - 2 * s and rsi < 30, false)) and flow > fm and not coalesce(rsi > 70, false), false) as buy,
  coalesce(((vf.v < vs.v and coalesce(adx, 0) > 25) or coalesce(close > m + 2 * s and rsi > 70, false)) and flow < fm and not coalesce(rsi < 30, false), false) as sell
  from vx join vf using (symbol, i) join vs using (symbol, i) join vr using (symbol, i) join adx using (symbol, i))"""


@query("sig_indicator_vote", _VOTE + " select symbol, i, case when buy then 1 when sell then -1 else 0 end as signal from vv", bars=True)
def sig_indicator_vote(spark, sf_dir):
    """Trend (crossing means with directional strength) or reversal (band and RSI), confirmed by volume flow."""
    x = rsi_columns(adx_columns(exponential(bars(spark, sf_dir), {"fast": ("close", 2 / 13), "slow": ("close", 2 / 27)})))
    w = by().rowsBetween(-19, 0)
    x = x.withColumns({"n": F.count("*").over(w), "m": F.avg("close").over(w), "s": F.stddev_samp("close").over(w), "before": F.lag("close").over(by())})
    x = x.withColumn("flow", F.sum(F.col("volume") * F.coalesce(F.signum(F.col("close") - F.col("before")), F.lit(0.0))).over(by())).withColumn("mean", F.avg("flow").over(w))
    return x.selectExpr("symbol", "i", f"case when n = 20 and ({_BUY}) then 1 when n = 20 and ({_SELL}) then -1 else 0 end as signal")


_BUY, _SELL = (f"((fast {a} slow and coalesce(adx, 0) > 25) or coalesce(close {a2} and rsi {r}, false)) and flow {a} mean and not coalesce(rsi {no}, false)" for a, a2, r, no in ((">", "< m - 2 * s", "< 30", "> 70"), ("<", "> m + 2 * s", "> 70", "< 30")))


@query("top_divergence", f""", hl as (select symbol, i, high, volume, max(i) over (partition by symbol) as mi, max(high) over ({P} rows between 5 preceding and 5 following) as m, count(*) over ({P} rows between 5 preceding and 5 following) as n from bars),
  pk as (select * from hl where n = 11 and high = m and i > mi - 90)
  select a.symbol, a.i as peak, arg_max(b.i, (b.high, -b.i)) as before, a.high > max(b.high) and a.volume < arg_max(b.volume, (b.high, -b.i)) as divergence from pk a join pk b on a.symbol = b.symbol and a.i - b.i between 8 and 60 group by a.symbol, a.i, a.high, a.volume""", bars=True)
def top_divergence(spark, sf_dir):
    """Recent peaks against the best peak 8 to 60 bars before: a higher high on less volume."""
    w = by().rowsBetween(-5, 5)
    x = bars(spark, sf_dir).withColumns({"m": F.max("high").over(w), "n": F.count("*").over(w), "mi": F.max("i").over(Window.partitionBy("symbol"))}).where("n = 11 and high = m and i > mi - 90")
    a, b = x.select("symbol", F.col("i").alias("peak"), F.col("high").alias("ah"), F.col("volume").alias("av")), x.select("symbol", "i", "high", "volume")
    j = a.join(b, "symbol").where("peak - i between 8 and 60")
    best = j.groupBy("symbol", "peak").agg(F.max_by(F.struct("i", "high", "volume"), F.struct("high", -F.col("i"))).alias("b"), F.first("ah").alias("ah"), F.first("av").alias("av"))
    return best.select("symbol", "peak", F.col("b.i").alias("before"), ((F.col("ah") > F.col("b.high")) & (F.col("av") < F.col("b.volume"))).alias("divergence"))
