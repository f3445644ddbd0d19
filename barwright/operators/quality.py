"""Quality gates: each gate is a table of violations or of counts, never an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by
from ..plans.registry import query
from ..sources.bars import WEEKS_SQL, bars, table, weekly_closes
from . import strokes
from .alignment import CAL, calendar
from .probability import EVAL, SPLIT, TLOG, banded, calibration_samples, evaluate, split_samples, target_log

STATUS = "case when now is null then 'missing' when delta > 5 then 'regressed' when delta < -5 then 'improved' else 'ok' end"
ACCURACY = "case when n < 30 then 'COLD' when rate < 40 then 'REVIEW' when rate < 55 then 'WATCH' else 'OK' end"

OHLC = "low > least(open, close) or high < greatest(open, close) or low > high"


@query("gate_ohlc", f"select symbol, count(*) as n, count(*) filter ({OHLC}) as violations from bars group by 1", bars=True)
def gate_ohlc(spark, sf_dir):
    return bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.expr(OHLC)).alias("violations"))


@query("gate_preflight", "select symbol, count(*) as n, count(*) >= 600 as enough, count(*) filter (close is null or close <= 0) as bad, 100.0 * count(*) filter (close is null or close <= 0) / count(*) <= 5 as clean, max(date)::varchar as last from bars group by 1", bars=True)
def gate_preflight(spark, sf_dir):
    bad = F.count_if(F.expr("close is null or close <= 0"))
    return bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), (F.count("*") >= 600).alias("enough"), bad.alias("bad"), (100.0 * bad / F.count("*") <= 5).alias("clean"), F.max("date").cast("string").alias("last"))


@query("gate_monotone", ", x as (select symbol, date > lag(date) over (partition by symbol order by i) as up from bars) select symbol, bool_and(coalesce(up, true)) as ascending from x group by 1", bars=True)
def gate_monotone(spark, sf_dir):
    x = bars(spark, sf_dir).withColumn("up", F.col("date") > F.lag("date").over(by()))
    return x.groupBy("symbol").agg(F.every(F.coalesce("up", F.lit(True))).alias("ascending"))


@query("gate_finite", "select count(*) filter (value is null or isnan(value) or isinf(value)) as bad, count(*) as n from events")
def gate_finite(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").agg(F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("bad"), F.count("*").alias("n"))


@query("quality_status", f", g as (select symbol, count(*) filter ({OHLC}) as bad, count(*) as n from bars group by 1) select symbol, case when bad = 0 and n >= 600 then 'OK' when bad <= n * 0.02 then 'WATCH' else 'REVIEW' end as status from g", bars=True)
def quality_status(spark, sf_dir):
    g = bars(spark, sf_dir).groupBy("symbol").agg(F.count_if(F.expr(OHLC)).alias("bad"), F.count("*").alias("n"))
    return g.select("symbol", F.expr("case when bad = 0 and n >= 600 then 'OK' when bad <= n * 0.02 then 'WATCH' else 'REVIEW' end").alias("status"))


@query("oos_guard", f"""{SPLIT}, g0 as (select symbol, train, avg(power(p - y, 2)) as brier from sc group by 1, 2), gd as (select symbol, round(max(brier) filter (train), 6) as base, round(max(brier) filter (not train), 6) as now from g0 group by 1) select *, now <= base * 1.05 as pass from gd""", bars=True)
def oos_guard(spark, sf_dir):
    """The Brier score of the later anchors may be at most 5 percent above that of the earlier ones, per symbol."""
    s = split_samples(calibration_samples(bars(spark, sf_dir))).withColumn("e", F.pow(F.col("p") - F.col("y"), 2))
    g = s.groupBy("symbol").agg(F.round(F.avg(F.when(F.col("train"), F.col("e"))), 6).alias("base"), F.round(F.avg(F.when(~F.col("train"), F.col("e"))), 6).alias("now"))
    return guard(g)


def guard(m: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Adds pass: now is at most `tolerance` above base."""
    return m.withColumn("pass", F.col("now") <= F.col("base") * (1 + tolerance))


@query("certificate", f"""{SPLIT}, g0 as (select symbol, train, avg(power(p - y, 2)) as brier from sc group by 1, 2), gd as (select symbol, round(max(brier) filter (train), 6) as base, round(max(brier) filter (not train), 6) as now from g0 group by 1),
  ct as (select *, round(100 * (now - base) / base, 4) as delta from gd) select symbol, delta, {{STATUS}} as status from ct""".replace("{STATUS}", STATUS), bars=True)
def certificate(spark, sf_dir):
    """Change of the Brier score in percent, and its status."""
    s = split_samples(calibration_samples(bars(spark, sf_dir))).withColumn("e", F.pow(F.col("p") - F.col("y"), 2))
    g = s.groupBy("symbol").agg(F.round(F.avg(F.when(F.col("train"), F.col("e"))), 6).alias("base"), F.round(F.avg(F.when(~F.col("train"), F.col("e"))), 6).alias("now"))
    return g.withColumn("delta", F.round(100 * (F.col("now") - F.col("base")) / F.col("base"), 4)).selectExpr("symbol", "delta", f"{STATUS} as status")


@query("accuracy_status", f"""{EVAL}, ac as (select symbol, count(*) filter (state <> 'pending') as n, round(100.0 * count(*) filter (state = 'hit') / nullif(count(*) filter (state <> 'pending'), 0), 4) as rate from ev2 group by 1) select symbol, n, rate, {ACCURACY} as status from ac""", bars=True)
def accuracy_status(spark, sf_dir):
    """Of the written targets that are decided: their number, the share that was hit, and what to make of it."""
    b = bars(spark, sf_dir)
    e = evaluate(banded(target_log(b), b), b).groupBy("symbol").agg(F.count_if(F.col("state") != "pending").alias("n"), F.round(100.0 * F.count_if(F.col("state") == "hit") / F.nullif(F.count_if(F.col("state") != "pending"), F.lit(0)), 4).alias("rate"))
    return e.selectExpr("symbol", "n", "rate", f"{ACCURACY} as status")


# Gates have to find what is wrong, so they run over a build of the bars that is spoilt in a known way as well as over the clean one.
SPOILT = "select symbol, date, i, open, case when i % 101 = 7 then low - 1 else high end as high, low, case when i % 97 = 5 then null when i % 89 = 3 then -close else close end as close, case when i % 83 = 2 then volume * 100 else volume end as volume from {bars} where i % 61 <> 13"


def spoilt(b: DataFrame) -> DataFrame:
    """The bars with highs below lows, closes missing or negative, volumes in the wrong unit, and days left out."""
    return b.selectExpr("symbol", "date", "i", "open", "case when i % 101 = 7 then low - 1 else high end as high", "low", "case when i % 97 = 5 then null when i % 89 = 3 then -close else close end as close", "case when i % 83 = 2 then volume * 100 else volume end as volume").where("i % 61 <> 13")


@query("document_diff", f", sp as ({SPOILT.replace('{bars}', 'bars')}), nb as (select symbol, date, i, open, high, low, close, volume from bars), l as (select count(*) as only_left from (select * from nb except all select * from sp)), r as (select count(*) as only_right from (select * from sp except all select * from nb)) select only_left, only_right from l, r", bars=True)
def document_diff(spark, sf_dir):
    """Rows that only one of two builds has: here a clean and a spoilt one."""
    a = bars(spark, sf_dir).select("symbol", "date", "i", "open", "high", "low", "close", "volume")
    return difference(a, spoilt(a))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.exceptAll(b).agg(F.count("*").alias("only_left")), b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.crossJoin(right)  # one row each


#: Checks of a table of bars: name and what is wrong with a row.
BAR_CHECKS = {"close": "close is null or close <= 0", "ohlc": OHLC, "volume": "volume < 0 or (m > 0 and (volume / m > 5 or volume / m < 0.2e0))", "gap": "gap > 5"}
_M = "case when n60 >= 10 then m60 end"


def bar_report(b: DataFrame) -> DataFrame:
    """check, n, violations: bad closes, bars whose prices contradict each other, volumes far from the median of 60, gaps of more
    than five days."""
    w = by().rowsBetween(-59, 0)
    x = b.withColumn("s_", F.array_sort(F.collect_list("volume").over(w))).withColumn("n_", F.size("s_"))
    x = x.withColumn("m", F.when(F.col("n_") >= 10, F.expr("(element_at(s_, cast((n_ + 1) div 2 as int)) + element_at(s_, cast(n_ div 2 + 1 as int))) / 2"))).withColumn("gap", F.datediff("date", F.lag("date").over(by())))
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.expr(e).alias("bad")) for n, e in BAR_CHECKS.items()])).alias("c")
    return x.select(one).groupBy("c.check").agg(F.count("*").alias("n"), F.count_if(F.col("c.bad")).alias("violations"))


_BAR_SQL = ", bx as (select *, case when count(volume) over w >= 10 then median(volume) over w end as m, datediff('day', lag(date) over (partition by symbol order by i), date) as gap from {t} window w as (partition by symbol order by i rows between 59 preceding and current row)) " + " union all ".join(f"select '{n}' as \"check\", count(*) as n, count(*) filter ({e}) as violations from bx" for n, e in BAR_CHECKS.items())


@query("gate_bars", _BAR_SQL.replace("{t}", "bars"), bars=True)
def gate_bars(spark, sf_dir):
    return bar_report(bars(spark, sf_dir))


@query("gate_bars_spoilt", f", sp as ({SPOILT.replace('{bars}', 'bars')})" + _BAR_SQL.replace("{t}", "sp"), bars=True)
def gate_bars_spoilt(spark, sf_dir):
    """The same checks over spoilt bars: each has to find its rows."""
    return bar_report(spoilt(bars(spark, sf_dir)))


@query("gate_freshness", ", fr as (select symbol, max(date) as last from bars group by 1), al as (select max(last) as today from fr), fs as (select symbol, last, today, datediff('day', last, today) as days from fr, al) select symbol, last::varchar as last, days, days between 0 and 30 as fresh, today = last as same_day from fs", bars=True)
def gate_freshness(spark, sf_dir):
    """Each series' last day against the latest one of all: from 0 to 30 days back."""
    f = bars(spark, sf_dir).groupBy("symbol").agg(F.max("date").alias("last"))
    x = f.crossJoin(f.agg(F.max("last").alias("today")))  # one row
    return x.select("symbol", F.col("last").cast("string").alias("last"), F.datediff("today", "last").alias("days"), F.datediff("today", "last").between(0, 30).alias("fresh"), (F.col("today") == F.col("last")).alias("same_day"))


@query("gate_snapshot_time", "select event_type, count(*) as n, count(*) filter (hour(ts) * 60 + minute(ts) >= 570 and hour(ts) * 60 + minute(ts) < 900) as within_session from events group by 1")
def gate_snapshot_time(spark, sf_dir):
    """Snapshots taken within a session (09:30 to 15:00) are not closing prices and are to be blocked."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if((minute >= 570) & (minute < 900)).alias("within_session"))


#: Ranges that structural results keep to: name, table expression, what is wrong.
@query("gate_structure", strokes.sql("""select 'strokes alternate' as "check", count(*) as n, count(*) filter (bad) as violations from (select dir = lag(dir) over (partition by symbol order by no) as bad from sk) union all select 'strokes go their way', count(*), count(*) filter ((p1 - p0) * dir <= 0) from sk
  union all select 'zones are open', count(*), count(*) filter (zg <= zd or gg < zg or dd > zd) from zn union all select 'zones in order', count(*), count(*) filter (bad) from (select start < lag("end") over (partition by symbol order by no) as bad from zn)""", strokes.structure_sql()))
def gate_structure(spark, sf_dir):
    """What strokes and zones must be like: alternating, going their way, open, in order."""
    s = strokes.strokes(bars(spark, sf_dir))
    z = strokes.zones(s)
    w = Window.partitionBy("symbol").orderBy("no")
    check = lambda f, name, bad: f.withColumn("bad_", bad).agg(F.lit(name).alias("check"), F.count("*").alias("n"), F.count_if(F.col("bad_")).alias("violations"))
    out = check(s, "strokes alternate", F.col("dir") == F.lag("dir").over(w)).union(check(s, "strokes go their way", F.expr("(p1 - p0) * dir <= 0")))
    return out.union(check(z, "zones are open", F.expr("zg <= zd or gg < zg or dd > zd"))).union(check(z, "zones in order", F.col("start") < F.lag("end").over(w)))


@query("gate_target_days", f"{TLOG}, {CAL}, tg as (select t.symbol, t.i, t.key, (b.date + t.expect::int)::date as day from tlog t join bars b using (symbol, i)) select tg.symbol, tg.i, tg.key, day::varchar as day, c.trading, (select min(d) from cal x where x.trading and x.d >= day)::varchar as moved from tg join cal c on c.d = day", bars=True)
def gate_target_days(spark, sf_dir):
    """The day on which the window of each written target ends, whether it is a trading day, and the one that it moves to."""
    b = bars(spark, sf_dir)
    t = target_log(b).join(b.select("symbol", "i", "date"), ["symbol", "i"]).withColumn("d", F.expr("date_add(date, expect)"))
    return t.join(calendar(spark), "d").select("symbol", "i", "key", F.col("d").cast("string").alias("day"), "trading", F.col("snapped").cast("string").alias("moved"))


@query("rising_days", f"""with recursive {CAL}, tg as (select o_custkey as g, o_orderkey as o, (row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1)::int as k, cast(o_orderdate as date) as day from orders),
  sn as (select g, o, k, (select min(session) from cal x where x.trading and x.d >= day) as s from tg), ri as (select g, o, k, s from sn where k = 0 union all select n.g, n.o, n.k, greatest(n.s, r.s + 1) from ri r join sn n on n.g = r.g and n.k = r.k + 1)
  select g, o, k, s::bigint as session, (select min(d) from cal x where x.trading and x.session = ri.s)::varchar as day from ri""")
def rising_days(spark, sf_dir):
    """The orders of each customer moved to trading days, each at least one session after the one before: with session numbers
    that is k plus the running maximum of session less k."""
    c, w = calendar(spark), Window.partitionBy("g").orderBy("o_orderdate", "o")
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("o"), "o_orderdate", F.col("o_orderdate").cast("date").alias("d")).withColumn("k", F.row_number().over(w) - 1)
    # a day without trading has the session before it, so the next one is one more
    x = t.join(c.select("d", (F.col("session") + F.when(F.col("trading"), 0).otherwise(1)).alias("next_")), "d")
    x = x.withColumn("session", F.col("k") + F.max(F.col("next_") - F.col("k")).over(Window.partitionBy("g").orderBy("k")))
    return x.select("g", "o", "k", "session").join(c.where("trading").select("session", F.col("d").cast("string").alias("day")), "session").select("g", "o", "k", "session", "day")


@query("gate_consistency", ", ev as (select symbol, arg_max(close, i) as close, max(date) as last, count(*) as n from bars group by 1)" + WEEKS_SQL.replace(" we as", " we as", 1).rstrip() + ", wl as (select symbol, arg_max(close, wi) as week_close, max(week) as week from weeks group by 1) select ev.symbol, week <= last as week_complete, abs(wl.week_close - b.close) < 1e-9 as week_agrees from ev join wl using (symbol) join bars b on b.symbol = ev.symbol and b.date = (select max(date) from bars x where x.symbol = ev.symbol and x.date <= wl.week)", bars=True)
def gate_consistency(spark, sf_dir):
    """Published weekly closes against the daily bars that they come from."""
    b = bars(spark, sf_dir)
    w = weekly_closes(b).groupBy("symbol").agg(F.max_by("close", "wi").alias("week_close"), F.max("week").alias("week"))
    x = b.join(w, "symbol").where("date <= week").groupBy("symbol", "week_close", "week").agg(F.max_by("close", "i").alias("close"))
    return x.join(b.groupBy("symbol").agg(F.max("date").alias("last")), "symbol").select("symbol", (F.col("week") <= F.col("last")).alias("week_complete"), (F.abs(F.col("week_close") - F.col("close")) < 1e-9).alias("week_agrees"))


@query("log_profile", TLOG + ", dd as (select symbol, i, key, count(*) as m from (select * from tlog union all select * from tlog where i % 100 = 0) group by 1, 2, 3) select symbol, count(distinct i) as days, round(count(*) / count(distinct i)::double, 6) as per_day, count(*) filter (m > 1) as repeated from dd group by 1", bars=True)
def log_profile(spark, sf_dir):
    """Targets a day, and keys that a log holds more than once (here every hundredth bar's were written twice)."""
    log = target_log(bars(spark, sf_dir))
    d = log.union(log.where("i % 100 = 0")).groupBy("symbol", "i", "key").agg(F.count("*").alias("m"))
    return d.groupBy("symbol").agg(F.countDistinct("i").alias("days"), F.round(F.count("*") / F.countDistinct("i"), 6).alias("per_day"), F.count_if(F.col("m") > 1).alias("repeated"))


@query("replay_status", EVAL + ", rs as (select symbol, min(i) filter (state = 'pending') as first_open, count(*) filter (state = 'pending') as open, max(i + expect) as horizon, any_value(n) as n from ev2 group by 1) select symbol, open, first_open, greatest(0, horizon - n)::int as bars_to_go from rs", bars=True)
def replay_status(spark, sf_dir):
    """Targets that are still open, the oldest of them, and the bars until the last window closes."""
    b = bars(spark, sf_dir)
    e = evaluate(banded(target_log(b), b), b).join(b.groupBy("symbol").agg(F.max("i").alias("n")), "symbol")
    x = e.groupBy("symbol").agg(F.count_if(F.col("state") == "pending").alias("open"), F.min(F.when(F.col("state") == "pending", F.col("i"))).alias("first_open"), F.max(F.col("i") + F.col("expect")).alias("horizon"), F.first("n").alias("n"))
    return x.select("symbol", "open", "first_open", F.greatest(F.lit(0), F.col("horizon") - F.col("n")).cast("int").alias("bars_to_go"))


#: Fields that a consumer reads of a published document.
CONTRACT = ("symbol", "date", "open", "high", "low", "close", "volume", "amount")


@query("field_contract", " union all ".join(f"select '{c}' as field, {'false' if c == 'amount' else 'true'} as present, {'count(*) * 0' if c == 'amount' else f'count({c})'}::bigint as filled from bars" for c in CONTRACT) , bars=True)
def field_contract(spark, sf_dir):
    """Fields of the contract, whether the table has them (it has no amount), and in how many of its rows they are filled."""
    b = bars(spark, sf_dir)
    one = b.agg(*[(F.count(c) if c in b.columns else F.lit(0).cast("long")).alias(c) for c in CONTRACT])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lit(c in b.columns).alias("present"), F.col(c).alias("filled")) for c in CONTRACT])).alias("x")).select("x.*")
