"""Structure of strokes: merged bars, fractals, strokes, zones and legs, and what is read off them.

Four steps depend on their own past: merging bars, pairing fractals, growing zones, and the larger legs. Each is a small
state that takes one row and gives back a row once that is final; `fold` runs it over the rows of a symbol, and the
next table is built on the result. Strokes with their spans and zones, which most readings use several times, are kept. Everything else is windows, aggregations and joins on (symbol, number). The SQL twins
state the same recursions as recursive queries.

A series that is to be analysed several times (as of other days, in other frames) is given as further symbols, so every
analysis is one job over all of them. The tables are small: a symbol has one stroke for some ten or twenty bars."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recursions import fold
from ..plans.registry import BARS_SQL, query
from ..sources.bars import bars, friday, resample
from ..sources.shared import kept
from .indicators import WILDER_SQL, macd_columns, sql_ema, trend_strength

# The least height of a stroke in daily, weekly and monthly bars, of a leg, and the divergence's share of area.
DAY, WEEK, MONTH = 0.018, 0.04, 0.08
LEG_TURN, WANING = 0.06, 0.85
#: No least height: strokes that are told by their distance alone.
STRICT = {"least": -1.0, "gap": 3}


# ----------------------------------------------------------------------------------------------------- recursions
class Merging:
    """Joins a bar to the open one if one holds the other: their upper edges in a rise, their lower ones otherwise. A rise
    is an open bar that is higher than the bar before it; the first bar has none before it and stays alone."""

    def __init__(self):
        self.open: tuple | None = None
        self.before: float | None = None

    def take(self, b) -> Iterator[tuple]:
        if self.open and self.before is not None and (b.high - self.open[0]) * (b.low - self.open[1]) <= 0:
            edge = max if self.open[0] > self.before else min
            self.open = (edge(self.open[0], b.high), edge(self.open[1], b.low), self.open[2], b.i)
            return
        if self.open:
            yield self.open
            self.before = self.open[0]
        self.open = (b.high, b.low, b.i, b.i)

    def rest(self) -> list[tuple]:
        return [self.open] if self.open else []


def merged(b: DataFrame) -> DataFrame:
    """symbol, no, high, low, i0, i1: bars without inclusion."""
    return fold(b.select("symbol", "i", "high", "low"), Merging, "i", "high double, low double, i0 int, i1 int")


def fractals(m: DataFrame) -> DataFrame:
    """symbol, at, kind (1 top, -1 bottom), high, low, i0, i1; a bar that is both counts as a top."""
    w = Window.partitionBy("symbol").orderBy("no")
    near = {f"{x}{n}": F.lag(x, n).over(w) for x in ("high", "low") for n in (1, -1)}
    top = (F.col("high") >= F.greatest("high1", "high-1")) & (F.col("low") >= F.greatest("low1", "low-1"))
    bottom = (F.col("low") <= F.least("low1", "low-1")) & (F.col("high") <= F.least("high1", "high-1"))
    f = m.withColumns(near).where("high1 is not null and `high-1` is not null").withColumn("kind", F.when(top, 1).when(bottom, -1))
    return f.where("kind is not null").select("symbol", F.col("no").alias("at"), "kind", "high", "low", "i0", "i1")


def pairing(least: float, gap: int):
    """The state that pairs tops and bottoms: an end is final once an opposite fractal is far and high enough from it."""

    class Pairing:
        def __init__(self):
            self.end = None

        def take(self, f) -> Iterator[tuple]:
            e = self.end
            if e is None:
                self.end = f
            elif f.kind == e.kind:
                if f.kind * (f.high if f.kind > 0 else f.low) >= e.kind * (e.high if e.kind > 0 else e.low):
                    self.end = f
            else:
                height = (e.high - f.low) / e.high if e.kind > 0 else (f.high - e.low) / e.low
                if f.at - e.at >= gap and height >= least:
                    yield e[1:]
                    self.end = f

        def rest(self) -> list[tuple]:
            return [self.end[1:]] if self.end is not None else []

    return Pairing


def strokes(b: DataFrame, least: float = DAY, gap: int = 2) -> DataFrame:
    """symbol, no, start, end (merged bars), dir, p0, p1, high, low, i0, i1 (bars)."""
    e = fold(fractals(merged(b)), pairing(least, gap), "at", "at int, kind int, high double, low double, i0 int, i1 int")
    w = Window.partitionBy("symbol").orderBy("no")
    e = e.withColumns({f"{x}_": F.lead(x).over(w) for x in ("at", "high", "low", "i1")}).where("at_ is not null")
    up = F.col("kind") < 0
    s = e.select(
        "symbol", "no", F.col("at").alias("start"), F.col("at_").alias("end"), (-F.col("kind")).alias("dir"), F.when(up, F.col("low")).otherwise(F.col("high")).alias("p0"),
        F.when(up, F.col("high_")).otherwise(F.col("low_")).alias("p1"), F.greatest("high", "high_").alias("high"), F.least("low", "low_").alias("low"), "i0", F.col("i1_").alias("i1"),
    )
    return s


class Growing:
    """Three strokes with a common range open a zone, which lasts while further strokes cut its range."""

    def __init__(self):
        self.zone: dict | None = None
        self.loose: list = []

    def take(self, s) -> Iterator[tuple]:
        z = self.zone
        if z and min(s.high, z["zg"]) > max(s.low, z["zd"]):
            z.update(end=s.end, gg=max(z["gg"], s.high), dd=min(z["dd"], s.low), count=z["count"] + 1)
            return
        if z:
            yield tuple(z.values())
        self.zone, self.loose = None, [*self.loose, s]
        if len(self.loose) == 3:
            top, bottom = min(x.high for x in self.loose), max(x.low for x in self.loose)
            if top > bottom:
                self.zone = {"start": self.loose[0].start, "end": s.end, "zg": top, "zd": bottom, "gg": max(x.high for x in self.loose), "dd": min(x.low for x in self.loose), "count": 3}
                self.loose = []
            else:
                self.loose = self.loose[1:]

    def rest(self) -> list[tuple]:
        return [tuple(self.zone.values())] if self.zone else []


def zones(s: DataFrame) -> DataFrame:
    """symbol, no, start, end, zg, zd, gg, dd, count, extension."""
    z = fold(s, Growing, "no", "start int, end int, zg double, zd double, gg double, dd double, count int")
    return kept(z.withColumn("extension", F.col("count") >= 9))


class Turning:
    """Extremes of the strokes' ends; one is final once the price has turned by LEG_TURN."""

    def __init__(self):
        self.far: tuple | None = None
        self.trend = 0

    def take(self, s) -> Iterator[tuple]:
        here = (s.no, s.end, s.p1)
        if self.far is None:
            self.far = here
            return
        last = self.far[2]
        self.trend = self.trend or (1 if s.p1 >= last else -1)
        if (s.p1 - last) * self.trend >= 0:
            self.far = here
        elif (s.p1 <= last * (1 - LEG_TURN)) if self.trend > 0 else (s.p1 >= last * (1 + LEG_TURN)):
            yield self.far
            self.far, self.trend = here, -self.trend

    def rest(self) -> list[tuple]:
        return [self.far] if self.far else []


def segments(s: DataFrame) -> DataFrame:
    """symbol, no, dir, start, end, p0, p1, high, low, i0, i1: legs over strokes; all strokes are one leg where there are no
    three of them, or no turn."""
    w = Window.partitionBy("symbol").orderBy("no")
    x = fold(s, Turning, "no", "stroke int, end int, p double").withColumns({"to": F.lead("stroke").over(w), "p_": F.lead("p").over(w)})
    many = s.groupBy("symbol").agg(F.count("*").alias("n"), F.min("no").alias("first"), F.max("no").alias("last"), F.min_by("dir", "no").alias("dir1"))
    legs = x.where("to is not null").join(many, "symbol").where("n >= 3").select("symbol", "no", F.col("stroke").alias("from"), "to", F.when(F.col("p_") >= F.col("p"), 1).otherwise(-1).alias("d"))
    whole = many.join(legs.select("symbol").distinct(), "symbol", "left_anti").select("symbol", F.lit(0).alias("no"), F.col("first").alias("from"), F.col("last").alias("to"), F.col("dir1").alias("d"))
    t = s.withColumnsRenamed({"symbol": "symbol_", "no": "no_"})
    own = legs.union(whole).join(t, (F.col("symbol") == F.col("symbol_")) & F.col("no_").between(F.col("from"), F.col("to")))
    first, last = (lambda c: F.min_by(c, "no_").alias(c)), (lambda c: F.max_by(c, "no_").alias(c))
    return own.groupBy("symbol", "no").agg(F.first("d").alias("dir"), first("start"), last("end"), first("p0"), last("p1"), F.max("high").alias("high"), F.min("low").alias("low"), first("i0"), last("i1"))


# ------------------------------------------------------------------------------------------- readings of the structure
def no() -> Window:
    return Window.partitionBy("symbol").orderBy("no")


def spans(s: DataFrame, b: DataFrame) -> DataFrame:
    """Adds area (of the momentum histogram, on the side of dir) and traded (volume) over the bars i0 to i1: differences of
    running sums, joined by bar."""
    h = (b if "hist" in b.columns else macd_columns(b)).select("symbol", "i", "hist", "volume")
    upto = Window.partitionBy("symbol").orderBy("i")
    h = h.withColumns({"up": F.greatest("hist", F.lit(0.0)), "down": F.greatest(-F.col("hist"), F.lit(0.0))})
    run = h.select("symbol", "i", *[F.sum(x).over(upto).alias(x) for x in ("up", "down", "volume")], *[(F.sum(x).over(upto) - F.col(x)).alias(f"{x}0") for x in ("up", "down", "volume")])
    end = run.select(F.col("symbol").alias("se"), F.col("i").alias("ie"), "up", "down", "volume")
    begin = run.select(F.col("symbol").alias("sb"), F.col("i").alias("ib"), "up0", "down0", "volume0")
    x = s.join(end, (F.col("symbol") == F.col("se")) & (F.col("i1") == F.col("ie"))).join(begin, (F.col("symbol") == F.col("sb")) & (F.col("i0") == F.col("ib")))
    area = F.when(F.col("dir") > 0, F.col("up") - F.col("up0")).otherwise(F.col("down") - F.col("down0"))
    return kept(x.select(*s.columns, F.round(area, 6).alias("area"), (F.col("volume") - F.col("volume0")).alias("traded")))


def momentum(b: DataFrame) -> DataFrame:
    """Bars with their momentum, kept: what several steps of an analysis read."""
    return kept(b if "hist" in b.columns else macd_columns(b))


def completed(s: DataFrame) -> DataFrame:
    """All strokes but the last, which may still grow; a single one counts."""
    w = Window.partitionBy("symbol")
    return s.withColumns({"m_": F.max("no").over(w)}).where("no < m_ or m_ = 0").drop("m_")


def waning(s: DataFrame, reach: tuple[str, str]) -> DataFrame:
    """Rows that go further than the one two before, on less than WANING of its area; reach: what goes further upwards and
    downwards."""
    up, down = reach
    x = s.withColumns({"qu": F.lag(up, 2).over(no()), "qd": F.lag(down, 2).over(no()), "qa": F.lag("area", 2).over(no()), "qdir": F.lag("dir", 2).over(no())})
    x = x.where((F.col("qa") > 0) & (F.col("dir") == F.col("qdir")) & (F.col("area") < F.col("qa") * WANING)).where(f"(dir = 1 and {up} > qu) or (dir = -1 and {down} < qd)")
    return x.withColumns({"type": F.when(F.col("dir") == 1, "top").otherwise("bottom"), "area_ratio": F.round(F.col("area") / F.col("qa"), 6)})


def divergences(s: DataFrame, z: DataFrame) -> DataFrame:
    """symbol, no, type, area_ratio, zones (that ended before the stroke), class, vol_ratio (to the upper median of the
    strokes of its direction), vol_confirm, dir, p1, i1; s with its spans."""
    d = waning(completed(s), ("p1", "p1"))
    before = z.select(F.col("symbol").alias("zs"), F.col("end").alias("ze"))
    d = d.join(before, (F.col("symbol") == F.col("zs")) & (F.col("ze") < F.col("start")), "left").groupBy("symbol", "no", "dir", "type", "area_ratio", "p1", "i1", "traded").agg(F.count("ze").alias("zones"))
    middle = s.groupBy("symbol", "dir").agg(F.array_sort(F.collect_list("traded")).alias("l")).select("symbol", "dir", F.element_at("l", (F.size("l") / 2).cast("int") + 1).alias("mid"))
    d = d.join(middle, ["symbol", "dir"])
    kind = F.when(F.col("zones") >= 2, "trend").when(F.col("zones") == 1, "range").otherwise("none")
    return d.select("symbol", "no", "type", "area_ratio", "zones", kind.alias("class"), F.when(F.col("mid") > 0, F.round(F.col("traded") / F.col("mid"), 3)).alias("vol_ratio"), ((F.col("mid") > 0) & (F.col("traded") < 0.92 * F.col("mid"))).alias("vol_confirm"), "dir", "p1", "i1")


def points(s: DataFrame, z: DataFrame, d: DataFrame) -> DataFrame:
    """symbol, no, kind (1, 2, 3), signal (1 buy, -1 sell), price, anchor (stroke or zone). Kind 1: a divergence. Kind 2: after each
    of them, the first stroke in its direction that does not pass its end. Kind 3: after each zone, the first stroke that
    comes back from outside of it and ends on that side of the zone's far edge."""
    done = completed(s)
    first = d.select("symbol", "no", F.lit(1).alias("kind"), (-F.col("dir")).alias("signal"), F.col("p1").alias("price"), F.col("no").alias("anchor"))
    later = done.select(F.col("symbol").alias("ls"), F.col("no").alias("later"), F.col("dir").alias("ldir"), F.col("p1").alias("lp"), F.col("p0").alias("lp0"), F.col("start").alias("lstart"))
    second = d.join(later, (F.col("symbol") == F.col("ls")) & (F.col("later") > F.col("no")) & (F.col("ldir") == F.col("dir")) & ((F.col("lp") - F.col("p1")) * F.col("dir") < 0))
    second = second.groupBy("symbol", "no", "dir").agg(F.min_by(F.struct("later", "lp"), "later").alias("x")).select("symbol", "x.later", F.lit(2), -F.col("dir"), "x.lp", "no")
    back = F.expr("lstart > end and ((ldir = -1 and lp0 > zg and lp > zd) or (ldir = 1 and lp0 < zd and lp < zg))")
    third = z.join(later, (F.col("symbol") == F.col("ls")) & back).groupBy("symbol", "no").agg(F.min_by(F.struct("later", "lp", "ldir"), "later").alias("x"))
    # kept: joined as it is, the union would be read by partitions that adaptive execution has changed
    return kept(first.union(second).union(third.select("symbol", "x.later", F.lit(3), -F.col("x.ldir"), "x.lp", "no")))


def plans(p: DataFrame, s: DataFrame, z: DataFrame, b: DataFrame) -> DataFrame:
    """Adds stop, target, rr and quality to buy and sell points."""
    w = no().rowsBetween(-30, -1)
    near = completed(s).select("symbol", "no", "start", "i1", F.max("high").over(w).alias("hi"), F.min("low").over(w).alias("lo"))
    zone = z.select(F.col("symbol").alias("zs"), F.col("end").alias("ze"), "zg", "zd")
    last = near.join(zone, (F.col("symbol") == F.col("zs")) & (F.col("ze") <= F.col("start")), "left").groupBy("symbol", "no", "i1", "hi", "lo").agg(F.max_by("zg", "ze").alias("zg"), F.max_by("zd", "ze").alias("zd"))
    c0 = F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("i")), "close")
    tr = b.select("symbol", "i", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c0), F.abs(F.col("low") - c0)).alias("tr"))
    atr = tr.select(F.col("symbol").alias("as"), F.col("i").alias("ai"), F.when(F.col("i") >= 13, F.avg("tr").over(Window.partitionBy("symbol").orderBy("i").rowsBetween(-13, 0))).alias("atr"))
    x = p.join(last, ["symbol", "no"]).join(atr, (F.col("symbol") == F.col("as")) & (F.col("i1") == F.col("ai")))
    return x.selectExpr("symbol", "no", "kind", "signal", "price", "anchor", f"{STOP} as stop", f"{TARGET} as target0").selectExpr("*", f"{CAPPED} as target").selectExpr("symbol", "no", "kind", "signal", "price", "anchor", "stop", "target", f"{RR} as rr").selectExpr("*", f"{QUALITY} as quality")


# Written once for both engines. A buy stops below the zone (kind 3) or the low of the last 30 strokes and aims at their high or
# the zone's projection; a sell mirrors that. At least 1.5 mean true ranges of room, at most six times the risk.
STOP = """case when signal = 1 then least(case when kind = 3 and zd is not null then zd * 0.99e0 when lo < price then lo * 0.99e0 else price * 0.97e0 end, coalesce(price - 1.5e0 * atr, 1e300))
  else greatest(case when kind = 3 and zg is not null then zg * 1.01e0 when hi > price then hi * 1.01e0 else price * 1.03e0 end, coalesce(price + 1.5e0 * atr, -1e300)) end"""
TARGET = """case when signal = 1 then greatest(price * 1.06e0, coalesce(hi, price), coalesce(case when zg <= price * 1.2e0 then zg end, 0e0), coalesce(zg + (zg - zd) * 0.618e0 * 0.9e0, 0e0))
  else least(price * 0.94e0, coalesce(lo, price), coalesce(case when zd >= price * 0.8e0 then zd end, 1e300), coalesce(zd - (zg - zd) * 0.618e0 * 0.9e0, 1e300)) end"""
CAPPED = "case when signal = 1 then least(target0, price + abs(price - stop) * 6e0) else greatest(target0, price - abs(price - stop) * 6e0) end"
RR = "case when abs(price - stop) > 0 and abs(target - price) > 0 then round(abs(target - price) / abs(price - stop), 2) end"
QUALITY = "case when rr is null then 'none' when rr >= 2.5e0 then 'best' when rr >= 1.5e0 then 'good' when rr >= 1e0 then 'fair' else 'poor' end"

# The scenario by the last stroke, its place against the last zone, and divergences of the last three strokes.
PLACE = "case when zg is null then 'none' when close > zg then 'above' when close < zd then 'below' else 'inside' end"
SCENARIO = """case when dir is null then 'no data' when tops > 0 and dir = 1 then 'topping divergence' when bottoms > 0 and dir = -1 then 'bottoming divergence'
  when place = 'above' and dir = 1 then 'rising' when place = 'inside' and dir = 1 then 'range, firm' when place = 'above' then 'pause below the high' when place = 'inside' then 'range, weak'
  when place = 'below' and dir = -1 then 'falling' when place = 'below' then 'rebound below the zone' when dir = 1 then 'no zone, up' else 'no zone, down' end"""
BULL = "('rising', 'range, firm', 'pause below the high', 'bottoming divergence')"
BEAR = "('topping divergence', 'range, weak', 'rebound below the zone', 'falling')"
POLARITY = f"case when scenario in {BULL} then 1 when scenario in {BEAR} then -1 else 0 end"
# The slope of the last five zones' middles and the close; it gives way where the scenario says the opposite.
TREND = """case when zones < 3 then 'sideways' when slope / level > 0.008e0 and scenario not in ('falling', 'rebound below the zone', 'topping divergence') then 'up'
  when slope / level < -0.008e0 and scenario not in ('rising', 'pause below the high', 'bottoming divergence') then 'down' else 'mixed' end"""


class Structure(NamedTuple):
    """What the readings of a table of bars have in common, each built once."""

    bars: DataFrame
    strokes: DataFrame
    zones: DataFrame
    legs: DataFrame
    divergences: DataFrame


def structure(b: DataFrame, least: float = DAY) -> Structure:
    """Bars with momentum, strokes and legs with their spans, zones, divergences; b is read once."""
    b = momentum(b)
    s = spans(strokes(b, least), b)
    z = zones(s)
    return Structure(b, s, z, spans(segments(s), b), divergences(s, z))


def scenarios(b: DataFrame, least: float = DAY, of: Structure | None = None) -> DataFrame:
    """One row per symbol: the last stroke, the last zone, recent divergences, the scenario, the kind of trend, and what the
    scores need."""
    b, s, z, g, d = of or structure(b, least)
    n = s.groupBy("symbol").agg(F.count("*").alias("strokes"), F.max_by("dir", "no").alias("dir"), F.max_by(F.col("p1") / F.col("p0") - 1, "no").alias("pct"), F.max_by(F.col("i1") - F.col("i0") + 1, "no").alias("bars"))
    recent = d.join(n.select("symbol", "strokes"), "symbol").where("no >= strokes - 3").groupBy("symbol").agg(F.count_if(F.col("type") == "top").alias("tops"), F.count_if(F.col("type") == "bottom").alias("bottoms"), F.count_if(F.col("vol_confirm")).alias("confirmed"))
    legs = waning(g, ("high", "low")).groupBy("symbol").agg(F.count_if(F.col("type") == "top").alias("leg_tops"), F.count_if(F.col("type") == "bottom").alias("leg_bottoms"))
    close = b.groupBy("symbol").agg(F.max_by("close", "i").alias("close"))
    k = z.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("no"))))
    last = k.groupBy("symbol").agg(F.count("*").alias("zones"), F.max(F.when(F.col("k") == 1, F.col("zg"))).alias("zg"), F.max(F.when(F.col("k") == 1, F.col("zd"))).alias("zd"))
    mids = k.where("k <= 5").select("symbol", (-F.col("k")).alias("x"), ((F.col("zd") + F.col("zg")) / 2).alias("y")).union(close.select("symbol", F.lit(0), "close"))
    slope = mids.groupBy("symbol").agg(F.regr_slope("y", "x").alias("slope"), F.avg("y").alias("level"))
    x = close.join(n, "symbol", "left").join(last, "symbol", "left").join(recent, "symbol", "left").join(legs, "symbol", "left").join(slope, "symbol", "left")
    x = x.fillna(0, ["zones", "tops", "bottoms", "confirmed", "leg_tops", "leg_bottoms", "strokes"])
    return x.withColumn("place", F.expr(PLACE)).withColumn("scenario", F.expr(SCENARIO)).withColumn("trend", F.expr(TREND)).withColumn("polarity", F.expr(POLARITY))


def weeks(b: DataFrame) -> DataFrame:
    return numbered(resample(b, friday("date")))


def months(b: DataFrame) -> DataFrame:
    return numbered(resample(b, F.trunc("date", "month")))


def numbered(f: DataFrame) -> DataFrame:
    return f.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("period")) - 1)


# ------------------------------------------------------------------------------------------------------- SQL twins
def structure_sql(source: str = "bars", p: str = "", least: float = DAY, gap: int = 2) -> str:
    """CTEs {p}mr .. {p}sg over source (symbol, i, high, low, close, volume), for a WITH RECURSIVE list."""
    high = "case when s.kind = 1 then (s.high - f.low) / s.high else (f.high - s.low) / s.low end"
    return f""", {p}mr as (select symbol, i, 0 as m, high as h, low as l, i as i0, null::double as ph from {source} where i = 0
  union all select symbol, bi, case when inside then m else m + 1 end, case when not inside then bh when h > ph then greatest(h, bh) else least(h, bh) end,
    case when not inside then bl when h > ph then greatest(l, bl) else least(l, bl) end, case when inside then i0 else bi end, case when inside then ph else h end
  from (select r.*, b.i as bi, b.high as bh, b.low as bl, m >= 1 and ((h >= b.high and l <= b.low) or (h <= b.high and l >= b.low)) as inside from {p}mr r join {source} b on b.symbol = r.symbol and b.i = r.i + 1)),
{p}mg as materialized (select symbol, m as no, arg_max(h, i) as high, arg_max(l, i) as low, any_value(i0) as i0, max(i) as i1 from {p}mr group by 1, 2),
{p}f0 as (select *, lag(high) over w as h1, lead(high) over w as h2, lag(low) over w as l1, lead(low) over w as l2 from {p}mg window w as (partition by symbol order by no)),
{p}f1 as (select *, case when high >= h1 and high >= h2 and low >= l1 and low >= l2 then 1 when low <= l1 and low <= l2 and high <= h1 and high <= h2 then -1 end as kind from {p}f0 where h1 is not null and h2 is not null),
{p}fq as materialized (select symbol, row_number() over (partition by symbol order by no) - 1 as f, no as mb, kind, high, low, i0, i1 from {p}f1 where kind is not null),
{p}st as (select symbol, f, 0 as e, mb, kind, high, low, i0, i1 from {p}fq where f = 0
  union all select symbol, f, case when grow then e + 1 else e end, case when grow or swap then fat else mb end, case when grow or swap then fkind else kind end, case when grow or swap then fh else high end,
    case when grow or swap then fl else low end, case when grow or swap then fi0 else i0 end, case when grow or swap then fi1 else i1 end
  from (select s.symbol, f.f, s.e, s.mb, s.kind, s.high, s.low, s.i0, s.i1, f.mb as fat, f.kind as fkind, f.high as fh, f.low as fl, f.i0 as fi0, f.i1 as fi1,
    f.kind <> s.kind and f.mb - s.mb >= {gap} and {high} >= {least} as grow, f.kind = s.kind and case when s.kind = 1 then f.high >= s.high else f.low <= s.low end as swap
    from {p}st s join {p}fq f on f.symbol = s.symbol and f.f = s.f + 1)),
{p}en as (select symbol, e, arg_max(mb, f) as mb, arg_max(kind, f) as kind, arg_max(high, f) as high, arg_max(low, f) as low, arg_max(i0, f) as i0, arg_max(i1, f) as i1 from {p}st group by 1, 2),
{p}sk as materialized (select symbol, e::int as no, mb::int as start, nat::int as "end", -kind as dir, case when kind = -1 then low else high end as p0, case when kind = -1 then nh else nl end as p1,
  greatest(high, nh) as high, least(low, nl) as low, i0::int as i0, ni1::int as i1
  from (select *, lead(mb) over w as nat, lead(high) over w as nh, lead(low) over w as nl, lead(i1) over w as ni1 from {p}en window w as (partition by symbol order by e)) where nat is not null),
{p}s3 as materialized (select *, lag(high) over w as h1, lag(low) over w as l1, lag(high, 2) over w as h2, lag(low, 2) over w as l2, lag(start, 2) over w as s2, lead(p1) over w as np from {p}sk window w as (partition by symbol order by no)),
{p}zr as (select symbol, no, -1 as z, 0 as cnt, 1 as loose, 0::int as zs, "end" as ze, 0.0::double as zg, 0.0::double as zd, 0.0::double as gg, 0.0::double as dd from {p}s3 where no = 0
  union all select symbol, no, case when opens then z + 1 else z end, case when more then cnt + 1 when opens then 3 else 0 end, case when more or opens then 0 else least(seen, 2) end, case when opens then s2 else zs end, se,
    case when opens then least(high, h1, h2) else zg end, case when opens then greatest(low, l1, l2) else zd end, case when more then greatest(gg, high) when opens then greatest(high, h1, h2) else gg end,
    case when more then least(dd, low) when opens then least(low, l1, l2) else dd end
  from (select *, not more and seen >= 3 and least(high, h1, h2) > greatest(low, l1, l2) as opens from (
    select r.symbol, s.no, r.z, r.cnt, r.zs, r.zg, r.zd, r.gg, r.dd, s.high, s.low, s.h1, s.l1, s.h2, s.l2, s.s2, s."end" as se, r.cnt > 0 and least(s.high, r.zg) > greatest(s.low, r.zd) as more, r.loose + 1 as seen
    from {p}zr r join {p}s3 s on s.symbol = r.symbol and s.no = r.no + 1))),
{p}zn as materialized (select symbol, z as no, any_value(zs)::int as start, arg_max(ze, no) as "end", any_value(zg) as zg, any_value(zd) as zd, arg_max(gg, no) as gg, arg_max(dd, no) as dd, max(cnt) as count from {p}zr where cnt > 0 group by 1, 2),
{p}lr as (select symbol, no, 0 as x, no as far, p1 as fp, case when np >= p1 then 1 else -1 end as trend from {p}s3 where no = 0
  union all select symbol, no, case when turns then x + 1 else x end, case when on_ or turns then no else far end, case when on_ or turns then p1 else fp end, case when turns then -trend else trend end
  from (select *, not on_ and case when trend = 1 then p1 <= fp * (1 - {LEG_TURN}) else p1 >= fp * (1 + {LEG_TURN}) end as turns from (
    select r.symbol, s.no, r.x, r.far, r.fp, r.trend, s.p1, (s.p1 - r.fp) * r.trend >= 0 as on_ from {p}lr r join {p}s3 s on s.symbol = r.symbol and s.no = r.no + 1))),
{p}ex as (select symbol, x, arg_max(far, no) as far, arg_max(fp, no) as fp from {p}lr group by 1, 2),
{p}nn as (select symbol, count(*) as n, arg_min(dir, no) as d1 from {p}sk group by 1),
{p}le as (select symbol, x as no, far as a, nfar as b, case when nfp >= fp then 1 else -1 end as d from (select *, lead(far) over w as nfar, lead(fp) over w as nfp from {p}ex window w as (partition by symbol order by x)) join {p}nn using (symbol) where nfar is not null and n >= 3),
{p}la as (select * from {p}le union all select symbol, 0, 0, n - 1, d1 from {p}nn where symbol not in (select symbol from {p}le)),
{p}sg as materialized (select la.symbol, la.no::int as no, any_value(la.d) as dir, arg_min(start, s.no) as start, arg_max("end", s.no) as "end", arg_min(p0, s.no) as p0, arg_max(p1, s.no) as p1, max(high) as high, min(low) as low, arg_min(i0, s.no) as i0, arg_max(i1, s.no) as i1
  from {p}la la join {p}sk s on s.symbol = la.symbol and s.no between la.a and la.b group by 1, 2)"""


def readings_sql(source: str = "bars", p: str = "") -> str:
    """CTEs {p}hs .. {p}dv after structure_sql: histogram, spans of strokes and legs, divergences of both."""
    area = lambda t, out: f"""{p}{out} as materialized (select s.*, round(sum(case when h.hist * s.dir > 0 then abs(h.hist) else 0 end), 6) as area, sum(h.volume) as traded
  from {p}{t} s join {p}hs h on h.symbol = s.symbol and h.i between s.i0 and s.i1 group by all)"""  # noqa: E731
    wane = lambda t, up, down: f"""select *, case when dir = 1 then 'top' else 'bottom' end as type, round(area / qa, 6) as area_ratio from (
  select *, lag({up}, 2) over w as qu, lag({down}, 2) over w as qd, lag(area, 2) over w as qa, lag(dir, 2) over w as qdir from {t} window w as (partition by symbol order by no))
  where qa > 0 and dir = qdir and area < qa * {WANING} and ((dir = 1 and {up} > qu) or (dir = -1 and {down} < qd))"""  # noqa: E731
    fast, slow, dea = (sql_ema("close", "(2.0/13)", f"{p}ef", source), sql_ema("close", "(2.0/27)", f"{p}es", source), sql_ema("x", "(2.0/10)", f"{p}ed", f"{p}di"))
    return f""", {fast}, {slow}, {p}di as (select f.symbol, f.i, f.v - s.v as x from {p}ef f join {p}es s using (symbol, i)), {dea},
{p}hs as materialized (select d.symbol, d.i, 2 * (d.x - e.v) as hist, b.volume from {p}di d join {p}ed e using (symbol, i) join {source} b using (symbol, i)),
{area('sk', 'sa')}, {area('sg', 'ga')},
{p}dn as (select * from {p}sa qualify no < max(no) over (partition by symbol) or max(no) over (partition by symbol) = 0),
{p}dw as ({wane(f'{p}dn', 'p1', 'p1')}), {p}gw as ({wane(f'{p}ga', 'high', 'low')}),
{p}md as (select symbol, dir, list_sort(list(traded))[(count(*) // 2 + 1)::int] as mid from {p}sa group by 1, 2),
{p}dv as materialized (select d.symbol, d.no, type, area_ratio, (select count(*) from {p}zn z where z.symbol = d.symbol and z."end" < d.start) as zones, case when mid > 0 then round(traded / mid, 3) end as vol_ratio,
  mid > 0 and traded < 0.92 * mid as vol_confirm, d.dir, p1, i1 from {p}dw d join {p}md m on m.symbol = d.symbol and m.dir = d.dir)"""


def scenario_sql(source: str = "bars", p: str = "", least: float = DAY) -> str:
    """CTEs up to {p}sc: one row per symbol, as scenarios()."""
    return structure_sql(source, p, least) + readings_sql(source, p) + f""", {p}c1 as (select symbol, arg_max(close, i) as close from {source} group by 1),
{p}c2 as (select symbol, count(*) as strokes, arg_max(dir, no) as dir, arg_max(p1 / p0 - 1, no) as pct, arg_max(i1 - i0 + 1, no) as bars from {p}sk group by 1),
{p}c3 as (select d.symbol, count(*) filter (type = 'top') as tops, count(*) filter (type = 'bottom') as bottoms, count(*) filter (vol_confirm) as confirmed from {p}dv d join {p}c2 c on c.symbol = d.symbol and d.no >= strokes - 3 group by 1),
{p}c4 as (select symbol, count(*) filter (type = 'top') as leg_tops, count(*) filter (type = 'bottom') as leg_bottoms from {p}gw group by 1),
{p}c5 as (select symbol, count(*) as zones, arg_max(zg, no) as zg, arg_max(zd, no) as zd from {p}zn group by 1),
{p}c6 as (select symbol, regr_slope(y, x) as slope, avg(y) as level from (select symbol, -row_number() over (partition by symbol order by no desc) as x, (zd + zg) / 2 as y from {p}zn qualify x >= -5 union all select symbol, 0, close from {p}c1) group by 1),
{p}c7 as (select c1.symbol, close, coalesce(strokes, 0) as strokes, dir, pct, bars, coalesce(zones, 0) as zones, zg, zd, coalesce(tops, 0) as tops, coalesce(bottoms, 0) as bottoms, coalesce(confirmed, 0) as confirmed, coalesce(leg_tops, 0) as leg_tops, coalesce(leg_bottoms, 0) as leg_bottoms, slope, level
  from {p}c1 c1 left join {p}c2 using (symbol) left join {p}c3 using (symbol) left join {p}c4 using (symbol) left join {p}c5 using (symbol) left join {p}c6 using (symbol)),
{p}c8 as (select *, {PLACE} as place from {p}c7), {p}c9 as (select *, {SCENARIO} as scenario from {p}c8),
{p}sc as materialized (select *, {TREND} as trend, {POLARITY} as polarity from {p}c9)"""


def sql(body: str, ctes: str) -> str:
    return f"with recursive {BARS_SQL}{ctes} {body}"


FRAMES = """, wk as (select symbol, (row_number() over (partition by symbol order by period) - 1)::int as i, high, low, close, volume from (select symbol, (date + ((12 - dayofweek(date)) % 7)::int)::date as period, max(high) as high, min(low) as low, arg_max(close, i) as close, sum(volume) as volume from bars group by 1, 2)),
mo as (select symbol, (row_number() over (partition by symbol order by period) - 1)::int as i, high, low, close, volume from (select symbol, date_trunc('month', date) as period, max(high) as high, min(low) as low, arg_max(close, i) as close, sum(volume) as volume from bars group by 1, 2))"""
ALL = structure_sql() + readings_sql()
THREE = FRAMES + scenario_sql() + scenario_sql("wk", "w", WEEK) + scenario_sql("mo", "m", MONTH)
POINTS = f""", pt as (select symbol, no, 1 as kind, -dir as signal, p1 as price, no as anchor from dv
  union all select d.symbol, min(l.no), 2, any_value(-d.dir), arg_min(l.p1, l.no), d.no from dv d join dn l on l.symbol = d.symbol and l.no > d.no and l.dir = d.dir and (l.p1 - d.p1) * d.dir < 0 group by d.symbol, d.no
  union all select z.symbol, min(l.no), 3, -arg_min(l.dir, l.no), arg_min(l.p1, l.no), z.no from zn z join dn l on l.symbol = z.symbol and l.start > z."end" and ((l.dir = -1 and l.p0 > zg and l.p1 > zd) or (l.dir = 1 and l.p0 < zd and l.p1 < zg)) group by z.symbol, z.no)"""
PLANS = POINTS + f""", nr as (select symbol, no, start, i1, max(high) over w as hi, min(low) over w as lo from dn window w as (partition by symbol order by no rows between 30 preceding and 1 preceding)),
tr as (select symbol, i, greatest(high - low, abs(high - c0), abs(low - c0)) as tr from (select *, coalesce(lag(close) over (partition by symbol order by i), close) as c0 from bars)),
ar as (select symbol, i, case when i >= 13 then avg(tr) over (partition by symbol order by i rows between 13 preceding and current row) end as atr from tr),
p0 as (select p.*, hi, lo, atr, (select arg_max(zg, "end") from zn z where z.symbol = p.symbol and z."end" <= nr.start) as zg, (select arg_max(zd, "end") from zn z where z.symbol = p.symbol and z."end" <= nr.start) as zd from pt p join nr using (symbol, no) join ar on ar.symbol = p.symbol and ar.i = nr.i1),
p1 as (select *, {STOP} as stop, {TARGET} as target0 from p0), p2 as (select *, {CAPPED} as target from p1), pl as (select *, {RR} as rr from p2)"""


# --------------------------------------------------------------------------------------------------------- queries
@query("merged_bars", sql("select symbol, no::int as no, high, low, i0::int as i0, i1::int as i1 from mg", structure_sql()))
def merged_bars(spark, sf_dir):
    return merged(bars(spark, sf_dir))


@query("fractals", sql("select symbol, mb::int as \"at\", kind::int as kind from fq", structure_sql()))
def fractals_query(spark, sf_dir):
    return fractals(merged(bars(spark, sf_dir))).select("symbol", "at", "kind")


@query("strokes", sql("select symbol, no, start, \"end\", dir::int as dir, p0, p1, high, low, i0, i1, round(area, 4) + 0.0 as area from sa", ALL))
def strokes_query(spark, sf_dir):
    b = momentum(bars(spark, sf_dir))
    return spans(strokes(b), b).drop("traded").withColumn("area", F.round("area", 4) + F.lit(0.0))


@query("strokes_strict", sql("select symbol, no, start, \"end\", dir::int as dir, p0, p1, high, low, i0, i1 from sk", structure_sql(least=-1.0, gap=3)))
def strokes_strict(spark, sf_dir):
    return strokes(bars(spark, sf_dir), **STRICT)


@query("pivot_zones", sql("select symbol, no::int as no, start, \"end\", zg, zd, gg, dd, count::int as count, count >= 9 as extension from zn", structure_sql()))
def pivot_zones(spark, sf_dir):
    return zones(strokes(bars(spark, sf_dir)))


@query("segments", sql("select symbol, no, dir::int as dir, start, \"end\", p0, p1, high, low from sg", structure_sql()))
def segments_query(spark, sf_dir):
    return segments(strokes(bars(spark, sf_dir))).drop("i0", "i1")


@query("stroke_divergence", sql("select symbol, no, type, round(area_ratio, 4) as area_ratio from dv", ALL))
def stroke_divergence(spark, sf_dir):
    b = momentum(bars(spark, sf_dir))
    s = spans(strokes(b), b)
    return divergences(s, zones(s)).select("symbol", "no", "type", F.round("area_ratio", 4).alias("area_ratio"))


@query("divergence_class", sql("select symbol, no, type, zones, case when zones >= 2 then 'trend' when zones = 1 then 'range' else 'none' end as class from dv", ALL))
def divergence_class(spark, sf_dir):
    """Trend divergence after two or more zones that ended before the stroke, one of the range after one."""
    b = momentum(bars(spark, sf_dir))
    s = spans(strokes(b), b)
    return divergences(s, zones(s)).select("symbol", "no", "type", "zones", "class")


@query("divergence_volume", sql("select symbol, no, vol_ratio, vol_confirm from dv", ALL))
def divergence_volume(spark, sf_dir):
    b = momentum(bars(spark, sf_dir))
    s = spans(strokes(b), b)
    return divergences(s, zones(s)).select("symbol", "no", "vol_ratio", "vol_confirm")


@query("segment_divergence", sql("select symbol, no, type, round(area_ratio, 4) as area_ratio from gw", ALL))
def segment_divergence(spark, sf_dir):
    """Legs that go further than the one two before on less momentum."""
    b = momentum(bars(spark, sf_dir))
    return waning(spans(segments(strokes(b)), b), ("high", "low")).select("symbol", "no", "type", F.round("area_ratio", 4).alias("area_ratio"))


@query("stroke_signals", sql("select symbol, no, kind, signal::int as signal, price, anchor::int as anchor from pt", ALL + POINTS))
def stroke_signals(spark, sf_dir):
    b = momentum(bars(spark, sf_dir))
    s = spans(strokes(b), b)
    z = zones(s)
    return points(s, z, divergences(s, z))


@query("signal_plans", sql(f"select symbol, no, kind, signal::int as signal, price, anchor::int as anchor, round(stop, 4) as stop, round(target, 4) as target, rr, {QUALITY} as quality from pl", ALL + PLANS))
def signal_plans(spark, sf_dir):
    """Stop, target, reward to risk and quality of every buy and sell point."""
    b = momentum(bars(spark, sf_dir))
    s = spans(strokes(b), b)
    z = zones(s)
    return plans(points(s, z, divergences(s, z)), s, z, b).withColumns({"stop": F.round("stop", 4), "target": F.round("target", 4)})


_SC = "symbol, scenario, place, dir::int as dir, round(pct, 6) as pct, leg_tops > 0 as leg_top, leg_bottoms > 0 as leg_bottom, trend, polarity::int as polarity"


@query("scenario", sql(f"select {_SC} from sc", scenario_sql()))
def scenario(spark, sf_dir):
    x = scenarios(bars(spark, sf_dir))
    return x.select("symbol", "scenario", "place", "dir", F.round("pct", 6).alias("pct"), (F.col("leg_tops") > 0).alias("leg_top"), (F.col("leg_bottoms") > 0).alias("leg_bottom"), "trend", "polarity")


RESONANCE = """case when d + w + m = 3 then 'all up' when d + w + m = -3 then 'all down' when d = 1 and w = -1 and m = 1 then 'rebound in a rising month' when d = -1 and w = 1 and m = -1 then 'dip in a falling month'
  when d <> w then case when d = 1 then 'day up, week down' else 'day down, week up' end else 'day and week agree' end"""
NESTING = """case when bottoms > 0 and w = -1 then 'bottom within a falling week' when tops > 0 and w = 1 then 'top within a rising week' when bottoms > 0 and w = 1 then 'bottom in a week that has turned up'
  when tops > 0 and w = -1 then 'top of a rebound in a falling week' else 'none' end"""


def frames(b: DataFrame, of: Structure | None = None) -> DataFrame:
    """Daily scenario with those of weeks and months: directions d, w, m, how they agree, the months' polarity."""
    of = of or structure(b)
    b, day = of.bars, scenarios(b, of=of)
    week = scenarios(weeks(b), WEEK).select("symbol", F.col("dir").alias("w"), F.col("scenario").alias("week_scenario"), F.col("polarity").alias("week_polarity"))
    month = scenarios(months(b), MONTH).select("symbol", F.col("dir").alias("m"), F.col("scenario").alias("month_scenario"), F.col("polarity").alias("month_polarity"))
    x = day.withColumn("d", F.col("dir")).join(week, "symbol").join(month, "symbol")
    return x.withColumns({"resonance": F.expr(RESONANCE), "nesting": F.expr(NESTING)})


@query("scenario_frames", sql(f"select symbol, d::int as d, w::int as w, m::int as m, week_scenario, month_scenario, month_polarity::int as month_polarity, {RESONANCE} as resonance, {NESTING} as nesting from fr3", THREE + ", fr3 as (select sc.*, sc.dir as d, wsc.dir as w, msc.dir as m, wsc.scenario as week_scenario, msc.scenario as month_scenario, msc.polarity as month_polarity from sc join wsc using (symbol) join msc using (symbol))"))
def scenario_frames(spark, sf_dir):
    return frames(bars(spark, sf_dir)).select("symbol", "d", "w", "m", "week_scenario", "month_scenario", "month_polarity", "resonance", "nesting")


BREADTH_LABEL = "case when score >= 0.5e0 then 'bulls lead' when score >= 0.2e0 then 'bullish, divided' when score > -0.2e0 then 'divided' when score > -0.5e0 then 'bearish' else 'bears lead' end"
CONCLUSION = """case when month_bull >= total * 0.6e0 and week_bear >= total * 0.6e0 and day_bull >= total * 0.6e0 then 'rebound, not a rise' when month_bull >= total * 0.6e0 and week_bear >= total * 0.6e0 then 'repair within a weekly fall'
  when week_bear >= total * 0.6e0 then 'weeks and months press' when day_bull >= total * 0.6e0 and month_bull < total * 0.6e0 then 'short rebound against weeks and months' when score >= 0 then 'levels agree, supporting' else 'levels agree, pressing' end"""


@query("breadth_composite", sql(f"select *, {BREADTH_LABEL} as label, {CONCLUSION} as conclusion from bc2", THREE + """, bc1 as (select count(*) as total, count(*) filter (sc.polarity = 1) as day_bull, count(*) filter (sc.polarity = -1) as day_bear, count(*) filter (wsc.polarity = 1) as week_bull, count(*) filter (wsc.polarity = -1) as week_bear,
  count(*) filter (msc.polarity = 1) as month_bull, count(*) filter (msc.polarity = -1) as month_bear from sc join wsc using (symbol) join msc using (symbol)),
  bc2 as (select *, round((0.2 * (day_bull - day_bear) + 0.4 * (week_bull - week_bear) + 0.4 * (month_bull - month_bear)) / total::double, 3) as score from bc1)"""))
def breadth_composite(spark, sf_dir):
    return composite(frames(bars(spark, sf_dir)))


def composite(x: DataFrame) -> DataFrame:
    """Polarities over all symbols of frames(): days weigh 0.2, weeks and months 0.4 each; one score, its label and what the levels say."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    cols = {f"{frame}_{side}": n(c, v) for frame, c in (("day", "polarity"), ("week", "week_polarity"), ("month", "month_polarity")) for side, v in (("bull", 1), ("bear", -1))}
    x = x.agg(F.count("*").alias("total"), *[v.alias(k) for k, v in cols.items()])
    x = x.withColumn("score", F.expr("round((0.2D * (day_bull - day_bear) + 0.4D * (week_bull - week_bear) + 0.4D * (month_bull - month_bear)) / total, 3)"))
    return x.withColumns({"label": F.expr(BREADTH_LABEL), "conclusion": F.expr(CONCLUSION)})


@query("adaptive_horizon", sql("select n.symbol, case when n < 4 then 60 else greatest(30, least(90, round_even(avg * 1.6, 0)))::int end as horizon from (select symbol, avg(i1 - i0 + 1) as avg from (select * from sk qualify row_number() over (partition by symbol order by no desc) <= 8) group by 1) a join nn n using (symbol)", structure_sql()))
def adaptive_horizon(spark, sf_dir):
    return horizons(strokes(bars(spark, sf_dir)))


def horizons(s: DataFrame) -> DataFrame:
    """1.6 times the mean length of the last 8 strokes, from 30 to 90 bars; 60 with fewer than four strokes."""
    s = s.withColumns({"k": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("no")))}).where("k <= 8")
    mean = F.bround(F.avg(F.col("i1") - F.col("i0") + 1) * 1.6)
    return s.groupBy("symbol").agg(F.when(F.count("*") < 4, 60).otherwise(F.greatest(F.lit(30), F.least(F.lit(90), mean)).cast("int")).alias("horizon"))


@query("method_agreement", sql("select a.symbol, count(*) as n, count(*) filter (near) as agree, round(count(*) filter (near) / count(*)::double, 6) as rate from (select s.symbol, exists (select 1 from xsk x join bars c on c.symbol = x.symbol and c.i = x.i1 where x.symbol = s.symbol and abs(datediff('day', c.date, b.date)) <= 2) as near from sk s join bars b on b.symbol = s.symbol and b.i = s.i1) a group by 1", structure_sql() + structure_sql(p="x", least=-1.0, gap=3)))
def method_agreement(spark, sf_dir):
    """Share of stroke ends that the strict method has within two days: its dates are spread by two days and joined by day."""
    b = kept(bars(spark, sf_dir))
    day = b.select("symbol", F.col("i").alias("i1"), "date")
    a = strokes(b).join(day, ["symbol", "i1"]).select("symbol", "no", "date")
    c = strokes(b, **STRICT).join(day, ["symbol", "i1"]).select("symbol", F.explode(F.sequence(F.date_sub("date", 2), F.date_add("date", 2))).alias("date")).distinct().withColumn("hit", F.lit(1))
    return a.join(c, ["symbol", "date"], "left").groupBy("symbol").agg(F.count("*").alias("n"), F.count("hit").alias("agree"), F.round(F.count("hit") / F.count("*"), 6).alias("rate"))


@query("known_pivots", sql("""select k.symbol, count(*) as known, count(*) filter (exists (select 1 from sk s join bars c on c.symbol = s.symbol and c.i = s.i1 where s.symbol = k.symbol and s.dir = k.dir and abs(datediff('day', c.date, k.date)) <= 12)) as captured from kp k group by 1""",
  structure_sql() + """, kp as (select symbol, year(date) as y, arg_max(date, (high, -i)) as date, 1 as dir from bars group by 1, 2 union all select symbol, year(date), arg_min(date, (low, i)), -1 from bars group by 1, 2)"""))
def known_pivots(spark, sf_dir):
    """Labelled turning points (here each year's high and low) with a stroke of their direction ending within twelve days."""
    b = kept(bars(spark, sf_dir))
    known = lambda agg, x, d: b.groupBy("symbol", F.year("date").alias("y")).agg(agg("date", x).alias("date")).select("symbol", "y", "date", F.lit(d).alias("dir"))
    k = known(F.max_by, F.struct("high", -F.col("i")), 1).union(known(F.min_by, F.struct("low", "i"), -1))
    return captured(k, strokes(b), b)


def captured(known: DataFrame, s: DataFrame, b: DataFrame, days: int = 12) -> DataFrame:
    ends = s.join(b.select("symbol", F.col("i").alias("i1"), F.col("date").alias("end_date")), ["symbol", "i1"]).select("symbol", "dir", F.explode(F.sequence(F.date_sub("end_date", days), F.date_add("end_date", days))).alias("date")).distinct().withColumn("hit", F.lit(1))
    return known.join(ends, ["symbol", "dir", "date"], "left").groupBy("symbol").agg(F.count("*").alias("known"), F.count("hit").alias("captured"))


STABLE = """case when polarity_moves > 0 then 'to be confirmed' when bars < 12 then 'borderline' else 'firm' end"""
_CUTS = ", cb as (select symbol || '#' || k as symbol, b.i, high, low, close, volume from bars b join (select symbol as s, max(i) as n from bars group by 1) on s = b.symbol, (select unnest([0, 1, 2, 3]) as k) where b.i <= n - k and (k = 0 or n + 1 > k + 30))"


@query("classification_stability", sql(f"""select symbol, bars::int as bars, moves > 0 as moved, case when bars >= 12 then 'established' else 'young' end as maturity, {STABLE} as level from (
  select b.symbol, b.bars, count(*) filter (c.k < b.bars and c.polarity <> b.polarity) as polarity_moves, count(*) filter (c.k < b.bars and (c.polarity <> b.polarity or c.side <> b.side)) as moves
  from st4 b join st4 c on c.symbol = b.symbol and c.k > 0 where b.k = 0 group by 1, 2, b.polarity, b.side)""", _CUTS + scenario_sql("cb", "c") + """, st4 as (select split_part(symbol, '#', 1) as symbol, split_part(symbol, '#', 2)::int as k, coalesce(bars, 1) as bars, polarity, case trend when 'up' then 1 when 'down' then -1 else 0 end as side from csc)"""))
def classification_stability(spark, sf_dir):
    return stability(bars(spark, sf_dir))


def stability(b: DataFrame) -> DataFrame:
    """The scenario again without the last one, two and three bars (fewer than the last stroke has): each cut is a symbol of
    its own, made where more than 30 bars are left. A last stroke under twelve bars is young; strokes alternate, so no run of them has one direction."""
    b = momentum(b)
    n = b.groupBy("symbol").agg(F.max("i").alias("n"))
    cut = b.join(n, "symbol").withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)]))).where("i <= n - k and (k = 0 or n + 1 > k + 30)").withColumn("symbol", F.concat_ws("#", "symbol", "k"))
    x = scenarios(cut.drop("n", "k")).select(F.split("symbol", "#")[0].alias("symbol"), F.split("symbol", "#")[1].cast("int").alias("k"), F.coalesce("bars", F.lit(1)).alias("bars"), "polarity", F.expr("case trend when 'up' then 1 when 'down' then -1 else 0 end").alias("side"))
    base = x.where("k = 0").select("symbol", "bars", F.col("polarity").alias("polarity0"), F.col("side").alias("side0"))
    c = x.where("k > 0").drop("bars").join(base, "symbol").groupBy("symbol", "bars").agg(F.count_if(F.expr("k < bars and polarity <> polarity0")).alias("polarity_moves"), F.count_if(F.expr("k < bars and (polarity <> polarity0 or side <> side0)")).alias("moves"))
    return c.selectExpr("symbol", "bars", "moves > 0 as moved", "case when bars >= 12 then 'established' else 'young' end as maturity", f"{STABLE} as level")


HEALTH = """greatest(0, least(100, 50 + case when place = 'above' then 15 when place = 'below' then -15 else 0 end + case when d = 1 then 10 else -10 end + case when d = w then 15 else -10 end + case when tops > 0 then -10 else 0 end + case when bottoms > 0 then 10 else 0 end))"""
# 40 to begin with; the week's direction, divergences, the order of the means, the win rate of kind 1, the trend's strength, volume.
CONFIDENCE = """greatest(0, least(100, floor(40 + case when d = w then 20 else -10 end + case when tops > 0 then -15 else 0 end + case when bottoms > 0 then 10 else 0 end
  + case when (alignment = 'bear' and polarity = 1) or (alignment = 'bull' and polarity <> 1) then -10 else 0 end + coalesce((win - 0.5e0) * 40, 0) + case when adx < 20 then -6 when adx >= 30 then 4 else 0 end
  + case when bottoms > 0 and confirmed > 0 then 5 else 0 end - case when tops > 0 and confirmed > 0 then 5 else 0 end)))"""


@query("health_score", sql(f"select symbol, {HEALTH}::int as health from (select sc.*, sc.dir as d, wsc.dir as w from sc join wsc using (symbol))", FRAMES + scenario_sql() + scenario_sql("wk", "w", WEEK)))
def health_score(spark, sf_dir):
    return frames(bars(spark, sf_dir)).selectExpr("symbol", f"cast({HEALTH} as int) as health")


def wins(p: DataFrame, s: DataFrame, b: DataFrame, h: int = 20) -> DataFrame:
    """Share of kind-1 points (buys, or sells where there are not three) whose next h bars go their way."""
    close = b.select("symbol", F.col("i").alias("i1"), (F.lead("close", h).over(Window.partitionBy("symbol").orderBy("i")) / F.col("close") - 1).alias("ret"))
    x = p.where("kind = 1").join(s.select("symbol", "no", "i1"), ["symbol", "no"]).join(close, ["symbol", "i1"]).where("ret is not null")
    part = lambda d: F.when(F.count_if(F.col("signal") == d) >= 3, F.avg(F.when(F.col("signal") == d, (F.col("ret") * d > 0).cast("int"))))
    return x.groupBy("symbol").agg(F.coalesce(part(1), part(-1)).alias("win"))


@query("forecast_confidence", sql(f"select symbol, {CONFIDENCE}::int as confidence from fc", FRAMES + scenario_sql() + scenario_sql("wk", "w", WEEK) + POINTS + WILDER_SQL + """, wn as (select symbol, coalesce(case when count(*) filter (signal = 1) >= 3 then avg((ret > 0)::int) filter (signal = 1) end, case when count(*) filter (signal = -1) >= 3 then avg((ret < 0)::int) filter (signal = -1) end) as win
  from (select p.symbol, p.signal, r.ret from pt p join dn s on s.symbol = p.symbol and s.no = p.no join (select symbol, i, lead(close, 20) over (partition by symbol order by i) / close - 1 as ret from bars) r on r.symbol = p.symbol and r.i = s.i1 where p.kind = 1 and ret is not null) group by 1),
ma as (select symbol, arg_max(al, i) as alignment from (select symbol, i, case when count(close) over (partition by symbol order by i rows between 249 preceding and current row) = 250 then case when close > a and a > b and b > c and c > d then 'bull' when close < a and a < b and b < c and c < d then 'bear' else 'mixed' end end as al
  from (select symbol, i, close, avg(close) over (partition by symbol order by i rows between 19 preceding and current row) as a, avg(close) over (partition by symbol order by i rows between 59 preceding and current row) as b, avg(close) over (partition by symbol order by i rows between 119 preceding and current row) as c, avg(close) over (partition by symbol order by i rows between 249 preceding and current row) as d from bars)) group by 1),
fc as (select sc.*, sc.dir as d, wsc.dir as w, win, alignment, lx.adx from sc join wsc using (symbol) left join wn using (symbol) left join ma using (symbol) left join lx on lx.symbol = sc.symbol)"""))
def forecast_confidence(spark, sf_dir):
    return confidences(structure(bars(spark, sf_dir))).select("symbol", "confidence")


def confidences(of: Structure) -> DataFrame:
    """frames() with the confidence, in which the trend's strength is that of `adx_wilder`."""
    b = of.bars
    w = lambda n: F.avg("close").over(Window.partitionBy("symbol").orderBy("i").rowsBetween(-(n - 1), 0))
    m = b.select("symbol", "i", "close", *[w(n).alias(f"m{n}") for n in (20, 60, 120, 250)])
    order = F.expr("case when i >= 249 then case when close > m20 and m20 > m60 and m60 > m120 and m120 > m250 then 'bull' when close < m20 and m20 < m60 and m60 < m120 and m120 < m250 then 'bear' else 'mixed' end end")
    m = m.groupBy("symbol").agg(F.max_by(order, "i").alias("alignment"))
    strength = trend_strength(b).select("symbol", "adx")
    x = frames(b, of).join(wins(points(of.strokes, of.zones, of.divergences), of.strokes, b), "symbol", "left").join(m, "symbol", "left").join(strength, "symbol", "left")
    return x.withColumn("confidence", F.expr(f"cast({CONFIDENCE} as int)"))


@query("structure_summary", sql("""select sc.symbol, strokes, zones, (select count(*) from sg g where g.symbol = sc.symbol) as legs, (select count(*) from dv d where d.symbol = sc.symbol) as divergences, (select count(*) from gw g where g.symbol = sc.symbol) as leg_divergences,
  (select count(*) from pt p where p.symbol = sc.symbol and kind = 1) as kind1, (select count(*) from pt p where p.symbol = sc.symbol and kind = 2) as kind2, (select count(*) from pt p where p.symbol = sc.symbol and kind = 3) as kind3, scenario, trend from sc""", scenario_sql() + POINTS))
def structure_summary(spark, sf_dir):
    """The whole analysis of each symbol in one row."""
    b = bars(spark, sf_dir)
    of = structure(b)
    of = of._replace(divergences=kept(of.divergences))
    b, s, z, g, d = of
    count = lambda f, c: f.groupBy("symbol").agg(F.count("*").alias(c))
    kinds = points(s, z, d).groupBy("symbol").agg(*[F.count_if(F.col("kind") == k).alias(f"kind{k}") for k in (1, 2, 3)])
    x = scenarios(b, of=of).select("symbol", "strokes", "zones", "scenario", "trend")
    for f in (count(g, "legs"), count(d, "divergences"), count(waning(g, ("high", "low")), "leg_divergences"), kinds):
        x = x.join(f, "symbol", "left")
    return x.fillna(0).select("symbol", "strokes", "zones", "legs", "divergences", "leg_divergences", "kind1", "kind2", "kind3", "scenario", "trend")


STRATEGY = """case when zg is null then 'no structure: wait' when scenario = 'rising' then format('hold; add above {0}; out below {1}') when scenario in ('range, firm', 'pause below the high') then format('trade {1} to {0}')
  when scenario = 'range, weak' then format('reduce below {1}') when scenario = 'rebound below the zone' then format('wait; range above {1}, up above {0}') when scenario = 'topping divergence' then format('reduce; support {0}')
  when scenario = 'bottoming divergence' then format('build up; resistance {1}') else format('reduce below {1}') end"""


def _strategy(zg: str, zd: str) -> str:
    import re

    def one(m):
        parts = [f"'{x}'" if k % 2 == 0 else (zg if x == "0" else zd) for k, x in enumerate(re.split(r"\{(\d)\}", m[1]))]
        return "concat(" + ", ".join(parts) + ")"

    return re.sub(r"format\('([^']*)'\)", one, STRATEGY)


@query("strategy_text", sql(f"select symbol, {_strategy('round(zg)::bigint::varchar', 'round(zd)::bigint::varchar')} as strategy from sc", scenario_sql()))
def strategy_text(spark, sf_dir):
    return scenarios(bars(spark, sf_dir)).selectExpr("symbol", f"{_strategy('cast(cast(round(zg) as bigint) as string)', 'cast(cast(round(zd) as bigint) as string)')} as strategy")


@query("stroke_fib_levels", sql("select symbol, f, round(case when dir = 1 then p1 - (p1 - p0) * f else p1 + (p0 - p1) * f end, 4) as level from (select * from sk qualify row_number() over (partition by symbol order by no desc) = 2), (select unnest([0.0, 0.382, 0.5, 0.618]::double[]) as f)", structure_sql()))
def stroke_fib_levels(spark, sf_dir):
    """Retracements of the last completed stroke."""
    s = strokes(bars(spark, sf_dir)).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("no")))).where("k = 2")
    return s.select("symbol", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.382, 0.5, 0.618)])).alias("f"), "dir", "p0", "p1").select("symbol", "f", F.round(F.expr("case when dir = 1 then p1 - (p1 - p0) * f else p1 + (p0 - p1) * f end"), 4).alias("level"))


# ------------------------------------------------------------------------------------------------------ chart layer
@query("zone_entry", sql("select z.symbol, z.no::int as no, (select arg_max(dir, \"end\") from sk s where s.symbol = z.symbol and s.\"end\" < z.start)::int as entry from zn z", structure_sql()))
def zone_entry(spark, sf_dir):
    """Direction of the last stroke that ended before each zone."""
    s = strokes(bars(spark, sf_dir))
    e = s.select(F.col("symbol").alias("ss"), F.col("end").alias("se"), "dir")
    return zones(s).join(e, (F.col("symbol") == F.col("ss")) & (F.col("se") < F.col("start")), "left").groupBy("symbol", "no").agg(F.max_by("dir", "se").alias("entry"))


@query("recent_zones", sql("select symbol, no::int as no, zg, zd from zn qualify row_number() over (partition by symbol order by no desc) <= 8", structure_sql()))
def recent_zones(spark, sf_dir):
    z = zones(strokes(bars(spark, sf_dir))).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("no"))))
    return z.where("k <= 8").select("symbol", "no", "zg", "zd")


@query("segment_extremes", sql("select symbol, no, case when abs(pv - far) > 1e-6 then i1 else spot end::int as \"at\", far as price, dir::int as dir from sx qualify row_number() over (partition by symbol order by no desc) <= 14", structure_sql() + """, sx as (select g.symbol, g.no, g.dir, g.i1, case when g.dir = 1 then g.high else g.low end as far,
  case when g.dir = 1 then arg_max(b.i, (b.high, -b.i)) else arg_min(b.i, (b.low, b.i)) end as spot, case when g.dir = 1 then max(b.high) else min(b.low) end as pv from sg g join bars b on b.symbol = g.symbol and b.i between g.i0 and g.i1 group by g.symbol, g.no, g.dir, g.i1, g.high, g.low)"""))
def segment_extremes(spark, sf_dir):
    """Bar and price of the far end of each of the last 14 legs; the leg's last bar where no bar has that price."""
    b = kept(bars(spark, sf_dir))
    g = segments(strokes(b)).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("no")))).where("k <= 14")
    inside = b.select(F.col("symbol").alias("bs"), "i", F.col("high").alias("bh"), F.col("low").alias("bl"))
    x = g.join(inside, (F.col("symbol") == F.col("bs")) & F.col("i").between(F.col("i0"), F.col("i1"))).groupBy("symbol", "no", "dir", "high", "low", "i1").agg(F.max_by("i", F.struct("bh", -F.col("i"))).alias("hi_at"), F.min_by("i", F.struct("bl", "i")).alias("lo_at"), F.max("bh").alias("hi"), F.min("bl").alias("lo"))
    return x.selectExpr("symbol", "no", "case when dir = 1 then case when abs(hi - high) > 1e-6 then i1 else hi_at end else case when abs(lo - low) > 1e-6 then i1 else lo_at end end as at", "case when dir = 1 then high else low end as price", "dir")


class Spacing:
    """Keeps a point if the last one kept of its direction is at least `least` bars back."""

    least = 55

    def __init__(self):
        self.last: dict[int, int] = {}

    def take(self, s) -> Iterator[tuple]:
        if s.i1 - self.last.get(s.signal, -999) >= self.least:
            self.last[s.signal] = s.i1
            yield s.i1, s.kind, s.signal

    def rest(self) -> list[tuple]:
        return []


@query("thinned_signals", sql("select symbol, (row_number() over (partition by symbol order by o) - 1)::int as no, i1, kind::int as kind, signal::int as signal from ts where keep", ALL + POINTS + """, to0 as (select p.symbol, s.i1, p.kind, p.signal, row_number() over (partition by p.symbol order by s.i1, p.kind, p.anchor) as o from pt p join dn s on s.symbol = p.symbol and s.no = p.no join (select symbol, max(i) + 1 as n from bars group by 1) m on m.symbol = p.symbol where s.i1 >= n - 500),
ts as (select symbol, o, i1, kind, signal, true as keep, case when signal = 1 then i1 else -999 end as up, case when signal = -1 then i1 else -999 end as dn from to0 where o = 1
  union all select t.symbol, t.o, t.i1, t.kind, t.signal, t.i1 - case when t.signal = 1 then ts.up else ts.dn end >= 55, case when t.signal = 1 and t.i1 - ts.up >= 55 then t.i1 else ts.up end, case when t.signal = -1 and t.i1 - ts.dn >= 55 then t.i1 else ts.dn end from ts join to0 t on t.symbol = ts.symbol and t.o = ts.o + 1)"""))
def thinned_signals(spark, sf_dir):
    """Buy and sell points of the last 500 bars, those of one direction at least 55 bars apart."""
    b = momentum(bars(spark, sf_dir))
    s = spans(strokes(b), b)
    z = zones(s)
    n = b.groupBy("symbol").agg((F.max("i") + 1).alias("n"))
    p = points(s, z, divergences(s, z)).join(s.select("symbol", "no", "i1"), ["symbol", "no"]).join(n, "symbol").where("i1 >= n - 500")
    p = p.withColumn("o", F.row_number().over(Window.partitionBy("symbol").orderBy("i1", "kind", "anchor"))).select("symbol", "o", "i1", "kind", "signal")
    return fold(p, Spacing, "o", "i1 int, kind int, signal int")


@query("quarter_flags", "select symbol, i, date::varchar as date, month(date) = 1 as new_year from (select *, lag(date) over (partition by symbol order by i) as d0 from bars) where d0 is null or quarter(d0) <> quarter(date) or year(d0) <> year(date)", bars=True)
def quarter_flags(spark, sf_dir):
    """First bar of each quarter."""
    d0 = F.lag("date").over(Window.partitionBy("symbol").orderBy("i"))
    b = bars(spark, sf_dir).withColumn("d0", d0).where("d0 is null or quarter(d0) <> quarter(date) or year(d0) <> year(date)")
    return b.select("symbol", "i", F.col("date").cast("string").alias("date"), (F.month("date") == 1).alias("new_year"))


@query("nearest_bar", "select e.symbol, e.day::varchar as day, arg_min(b.i, (abs(datediff('day', e.day, b.date)), b.i))::int as i from (select symbol, (date_trunc('month', date) + interval 14 days)::date as day from bars group by all) e join bars b on b.symbol = e.symbol and b.date between e.day - 40 and e.day + 40 group by 1, 2", bars=True)
def nearest_bar(spark, sf_dir):
    """The bar nearest to an event's day (here the 15th of each month), the earlier of two: the last bar up to it and the
    first one after it, by one sorted union, without a range join."""
    b = momentum(bars(spark, sf_dir))
    e = b.select("symbol", F.date_add(F.trunc("date", "month"), 14).alias("day")).distinct()
    every = b.select("symbol", F.col("date").alias("t"), "i", F.lit(None).cast("date").alias("day")).union(e.select("symbol", "day", F.lit(None).cast("int"), "day"))
    w = Window.partitionBy("symbol").orderBy("t", F.col("day").asc_nulls_first())
    bar = F.when(F.col("i").isNotNull(), F.struct("t", "i"))
    x = every.withColumns({"before": F.last(bar, True).over(w), "after": F.first(bar, True).over(w.rowsBetween(1, Window.unboundedFollowing))}).where("day is not null")
    pick = F.expr("case when before is null or datediff(after.t, day) < datediff(day, before.t) then after.i else before.i end")
    return x.select("symbol", F.col("day").cast("string").alias("day"), pick.alias("i"))


# ------------------------------------------------------------------------------------------------- path back-test
#: Far end of the main path, level of the risk path, and the main path's direction, by scenario.
PATH_DIR = "case when scenario in ('rising', 'range, firm', 'pause below the high', 'bottoming divergence') then 1 when scenario in ('topping divergence', 'range, weak', 'rebound below the zone', 'falling') then -1 else 0 end"
PATH_TARGET = """case when scenario = 'rising' then greatest(zg * 1.01e0, close * (1 + move)) * 1.03e0 when scenario in ('range, firm', 'pause below the high') then zg * 1.03e0 when scenario = 'bottoming divergence' then zg * 1.02e0
  when scenario in ('topping divergence', 'range, weak', 'rebound below the zone', 'falling') then (zg + zd) / 2 * 0.99e0 else (zg + zd) / 2 end"""
PATH_RISK = """case when scenario in ('rising', 'range, firm', 'pause below the high') then zd * 0.94e0 when scenario = 'bottoming divergence' then zd * 0.93e0
  when scenario in ('topping divergence', 'range, weak', 'rebound below the zone', 'falling') then zd * 0.92e0 else zd * 0.99e0 end"""


@query("path_targets", sql(f"select symbol, scenario, round({PATH_TARGET}, 4) as target, round({PATH_RISK}, 4) as risk, {PATH_DIR} as main_dir from (select *, 0.05::double as move from sc where zg is not null)", scenario_sql()))
def path_targets(spark, sf_dir):
    x = scenarios(bars(spark, sf_dir)).where("zg is not null").withColumn("move", F.lit(0.05))
    return x.selectExpr("symbol", "scenario", f"round({PATH_TARGET}, 4) as target", f"round({PATH_RISK}, 4) as risk", f"{PATH_DIR} as main_dir")


def path_samples(b: DataFrame, horizon: int = 60, step: int = 20, first: int = 260) -> DataFrame:
    """symbol, t, scenario, main_dir, hit (main, alt, risk), weight: the analysis as of every `step`-th bar from `first`, each a
    symbol of its own, against the next `horizon` bars. Samples of earlier years weigh half as much a year."""
    n = b.groupBy("symbol").agg(F.max("i").alias("n"))
    at = n.where(F.col("n") - horizon >= first).select("symbol", F.col("n"), F.explode(F.sequence(F.lit(first), F.col("n") - horizon, F.lit(step))).alias("t"))
    sub = b.join(at.select("symbol", "t"), "symbol").where("i <= t").withColumn("symbol", F.concat_ws("#", "symbol", "t")).drop("t")
    x = scenarios(sub).where("zg is not null")
    done = strokes(sub).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("no")))).where("k <= 2")
    move = done.groupBy("symbol").agg(F.greatest(F.max_by(F.abs(F.col("p1") / F.col("p0") - 1), "k"), F.lit(0.03)).alias("move"))
    x = x.join(move, "symbol").selectExpr("split(symbol, '#')[0] as symbol", "cast(split(symbol, '#')[1] as int) as t", "scenario", f"{PATH_TARGET} as target", f"{PATH_RISK} as risk", f"{PATH_DIR} as main_dir")
    w = Window.partitionBy("symbol").orderBy("i").rowsBetween(1, horizon)
    ahead = b.select("symbol", F.col("i").alias("t"), F.max("high").over(w).alias("hi"), F.min("low").over(w).alias("lo"))
    hit = "case when main_dir = 1 then case when hi >= target then 'main' when lo <= risk then 'risk' else 'alt' end when main_dir = -1 then case when lo <= risk then 'risk' when lo <= target then 'main' else 'alt' end when hi >= target and lo > risk then 'main' when lo <= risk then 'risk' else 'alt' end"
    return x.join(ahead, ["symbol", "t"]).join(n, "symbol").selectExpr("symbol", "t", "scenario", "main_dir", f"{hit} as hit", "power(0.5D, (n + 1 - t) / 244.0D) as weight")


@query("path_hit_rates")
def path_hit_rates(spark, sf_dir):
    """Weighted counts of the paths taken, by scenario, by direction, and in all. SQL would need the recursion once per bar;
    the test holds it against analyses of cut series one by one."""
    x = path_samples(momentum(bars(spark, sf_dir)))
    part = lambda h: F.round(F.sum(F.when(F.col("hit") == h, F.col("weight")).otherwise(0.0)), 6).alias(h)
    return x.groupingSets([["symbol", "scenario"], ["symbol", "main_dir"], ["symbol"]], "symbol", "scenario", "main_dir").agg(F.count("*").alias("samples"), F.round(F.sum("weight"), 6).alias("n"), part("main"), part("alt"), part("risk"))


#: A path's share of hits against the probability that was stated for it.
VERDICT = "case when n < 3 then 'few samples' when stated - 100 * main / n > 8 then 'optimistic' when stated - 100 * main / n < -8 then 'cautious' else 'consistent' end"


@query("path_verdict")
def path_verdict(spark, sf_dir):
    """Stated chance of the main path (here 55 percent) against its history, eight points either way."""
    x = path_samples(momentum(bars(spark, sf_dir))).groupBy("main_dir").agg(F.sum("weight").alias("n"), F.sum(F.when(F.col("hit") == "main", F.col("weight")).otherwise(0.0)).alias("main")).withColumn("stated", F.lit(55.0))
    return x.selectExpr("main_dir", "round(n, 4) as n", "round(100 * main / n, 4) as realized", f"{VERDICT} as verdict")
