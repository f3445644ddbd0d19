"""A sentiment score from momentum, position, volume, volatility and breadth, and the statistics of what followed it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by, clamp, full, last, lead, mean
from ..plans.registry import ORACLES, query
from ..sources.bars import bars
from ..sources.shared import kept
from .indicators import sql_last, trailing_rank, volume_ratios, with_returns

P = "partition by symbol order by i"
BREADTH = 0.5  # in [0, 1]; where no source is available the sub-score is 0
WEIGHTS = (0.30, 0.20, 0.20, 0.15, 0.15)


def sub_scores(b: DataFrame, windows: tuple[int, ...] = (20,), divisor: float | None = None) -> DataFrame:
    """symbol, i, close, ma250, mom, pos, vol, volat (each from -1 to 1), from the 250th bar on; mom<n> for further windows.
    divisor: of the volume ratio, in place of its own spread."""
    v = volume_ratios(b)
    v = v.withColumn("vdiv", F.when(F.count("vr").over(Window.partitionBy("symbol")) < 30, 0.5).otherwise(F.greatest(F.lit(0.08), F.stddev_pop("vr").over(Window.partitionBy("symbol")))))
    x = with_returns(v)
    x = x.withColumn("hv", F.round(full(F.stddev_pop("simple").over(last(20)), F.col("simple"), 20, last(20)) * (252**0.5), 8)).withColumn("ma250", mean("close", 250)).withColumn("c20", F.lag("close", 20).over(by()))
    x = x.withColumns({f"mom{n}": clamp((F.col("close") / F.lag("close", n).over(by()) - 1) * 100 / 8, -1.0, 1.0) for n in windows if n != 20})
    x = trailing_rank(x, "hv", 250, "pctile").where("i >= 249")
    mom, pos = clamp((F.col("close") / F.col("c20") - 1) * 100 / 8, -1.0, 1.0), clamp((F.col("close") / F.col("ma250") - 1) / 0.15, -1.0, 1.0)
    vol, volat = clamp(F.col("vr") / F.col("vdiv"), -1.0, 1.0), clamp(1 - F.coalesce("pctile", F.lit(50.0)) / 50, -1.0, 1.0)
    if divisor:
        vol = clamp(F.coalesce("vr", F.lit(0.0)) / divisor, -1.0, 1.0)
    more = [F.col(f"mom{n}") for n in windows if n != 20]
    return x.select("symbol", "i", "close", "ma250", mom.alias("mom"), pos.alias("pos"), vol.alias("vol"), volat.alias("volat"), *more)


def history(b: DataFrame, breadth: float = BREADTH) -> DataFrame:
    """symbol, i, close, score (0 to 100, one place), bear, from the 250th bar on. The breadth of the past is not known, so its
    sub-score is that of a neutral breadth; today's is in sentiment_today."""
    x = sub_scores(b)
    total = sum((w * F.col(c) for w, c in zip(WEIGHTS[1:4], ("pos", "vol", "volat"))), WEIGHTS[0] * F.col("mom")) + WEIGHTS[4] * F.lit((breadth - 0.5) * 2)
    score = F.floor(clamp(50 + 50 * total, 0.0, 100.0) * 10 + 0.5000001).cast("long") / 10.0
    return x.select("symbol", "i", "close", score.alias("score"), (F.col("close") < F.col("ma250")).alias("bear"))


HIST = f""", s0 as (select *, close / lag(close) over ({P}) - 1 as simple, lag(close, 20) over ({P}) as c20, {sql_last('avg', 'close', 250)} as ma250, ({sql_last('avg', 'volume', 20)}) / ({sql_last('avg', 'volume', 250)}) - 1 as vr from bars),
s1 as (select *, round(({sql_last('stddev_pop', 'simple', 20)}) * {252**0.5!r}, 8) as hv, case when count(vr) over (partition by symbol) < 30 then 0.5 else greatest(0.08, stddev_pop(vr) over (partition by symbol)) end as vdiv from s0),
pr as (select a.symbol, a.i, 100.0 * count(*) filter (b.hv <= a.hv) / count(b.hv) as pctile from s1 a join s1 b on a.symbol = b.symbol and b.i between a.i - 249 and a.i where a.hv is not null and a.i >= 249 group by 1, 2),
hist as (select symbol, i, close, floor(greatest(0, least(100, 50 + 50 * (0.30 * greatest(-1, least(1, (close / c20 - 1) * 100 / 8)) + 0.20 * greatest(-1, least(1, (close / ma250 - 1) / 0.15)) + 0.20 * greatest(-1, least(1, vr / vdiv)) + 0.15 * greatest(-1, least(1, 1 - pctile / 50)) + 0.15 * 0.0))) * 10 + 0.5000001)::bigint / 10.0 as score, close < ma250 as bear from s1 join pr using (symbol, i)) """


@query("sentiment_history", HIST + "select symbol, i, score, bear from hist", bars=True)
def sentiment_history(spark, sf_dir):
    return history(bars(spark, sf_dir)).select("symbol", "i", "score", "bear")


#: The fixed edges where there are fewer than 30 scores or no spread.
FIXED_EDGES = (20.0, 40.0, 60.0, 80.0)


def bands(h: DataFrame) -> DataFrame:
    """Band edges: the 10th, 30th, 70th and 90th percentiles of each symbol's own scores; FIXED_EDGES where there are fewer than
    30 scores or two edges coincide."""
    x = h.groupBy("symbol").agg(F.percentile("score", [0.1, 0.3, 0.7, 0.9]).alias("q"), F.count("score").alias("n"))
    good = F.expr("n >= 30 and round(q[0], 2) < round(q[1], 2) and round(q[1], 2) < round(q[2], 2) and round(q[2], 2) < round(q[3], 2)")
    return x.select("symbol", *[F.when(good, F.round(F.col("q")[k], 2)).otherwise(FIXED_EDGES[k]).alias(f"q{k}") for k in range(4)])


_GOOD = "n >= 30 and round(q[1], 2) < round(q[2], 2) and round(q[2], 2) < round(q[3], 2) and round(q[3], 2) < round(q[4], 2)"
BANDS = ", bd as (select symbol, " + ", ".join(f"case when {_GOOD} then round(q[{k + 1}], 2) else {FIXED_EDGES[k]} end::double as q{k}" for k in range(4)) + " from (select symbol, count(score) as n, quantile_cont(score::double, [0.1, 0.3, 0.7, 0.9]) as q from hist group by 1)) "
LABEL = "case when score < q0 then 'very_cold' when score < q1 then 'cold' when score < q2 then 'neutral' when score < q3 then 'hot' else 'very_hot' end"


@query("sentiment_bands", HIST + BANDS + "select * from bd", bars=True)
def sentiment_bands(spark, sf_dir):
    return bands(history(bars(spark, sf_dir)))


def labelled(b: DataFrame, h: int = 20) -> DataFrame:
    """History with its band and the return of the next h bars."""
    x = history(b).withColumn("fwd", lead("close", h) / F.col("close") - 1)
    return x.join(bands(x), "symbol").withColumn("band", F.expr(LABEL))


LAB = HIST + BANDS + f", lb as (select *, {LABEL} as band, lead(close, 20) over ({P}) / close - 1 as fwd, score - lag(score, 5) over ({P}) as d5 from hist join bd using (symbol)) "


@query("sentiment_fwd_by_band", LAB + "select band, regime, count(*) as n, round(avg(fwd), 6) + 0.0 as fwd, round(avg((fwd > 0)::int), 6) as up from (select *, case when bear then 'bear' else 'bull' end as regime from lb where fwd is not null) group by grouping sets ((band), (band, regime))", bars=True)
def sentiment_fwd_by_band(spark, sf_dir):
    x = labelled(bars(spark, sf_dir)).where("fwd is not null").withColumn("regime", F.when(F.col("bear"), "bear").otherwise("bull"))
    return x.groupingSets([["band"], ["band", "regime"]], "band", "regime").agg(F.count("*").alias("n"), (F.round(F.avg("fwd"), 6) + 0.0).alias("fwd"), F.round(F.avg((F.col("fwd") > 0).cast("int")), 6).alias("up"))


@query("sentiment_quadrants", LAB + "select score >= 50 as high, d5 >= 0 as rising, count(*) as n, round(avg(fwd), 6) + 0.0 as fwd from lb where fwd is not null and d5 is not null group by 1, 2", bars=True)
def sentiment_quadrants(spark, sf_dir):
    x = labelled(bars(spark, sf_dir)).withColumn("d5", F.col("score") - F.lag("score", 5).over(by())).where("fwd is not null and d5 is not null")
    return x.groupBy((F.col("score") >= 50).alias("high"), (F.col("d5") >= 0).alias("rising")).agg(F.count("*").alias("n"), (F.round(F.avg("fwd"), 6) + 0.0).alias("fwd"))


HS = (5, 10, 20, 40, 60)


def by_horizon(x: DataFrame) -> DataFrame:
    x = x.withColumns({f"f{h}": lead("close", h) / F.col("close") - 1 for h in HS})
    return x.withColumn("z", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"f{h}").alias("f")) for h in HS]))).select("*", "z.h", "z.f").where("f is not null")


BYH = f", bh as (select *, lead(close, h::int) over (partition by symbol, h order by i) / close - 1 as f from hist join bd using (symbol), (select unnest({list(HS)}) as h)) "


@query("horizon_scan", HIST + BANDS + BYH + "select h::int as h, round(avg(f) filter (score < q1) - avg(f) filter (score >= q2), 6) + 0.0 as spread, count(f) as n from bh where f is not null group by 1", bars=True)
def horizon_scan(spark, sf_dir):
    """Mean return after cold scores less that after hot ones, for several horizons."""
    x = history(bars(spark, sf_dir))
    x = by_horizon(x.join(bands(x), "symbol"))
    part = lambda c: F.avg(F.when(F.expr(c), F.col("f")))
    return x.groupBy("h").agg((F.round(part("score < q1") - part("score >= q2"), 6) + 0.0).alias("spread"), F.count("f").alias("n"))


@query("extreme_reversal", HIST + BANDS + BYH + "select h::int as h, count(*) filter (score < q0) as cold, round(avg((f > 0)::int) filter (score < q0), 6) as cold_up, count(*) filter (score >= q3) as hot, round(avg((f < 0)::int) filter (score >= q3), 6) as hot_down from bh where f is not null group by 1", bars=True)
def extreme_reversal(spark, sf_dir):
    x = history(bars(spark, sf_dir))
    x = by_horizon(x.join(bands(x), "symbol"))
    share = lambda on, what: F.round(F.avg(F.when(F.expr(on), F.expr(what).cast("int"))), 6)
    return x.groupBy("h").agg(F.count_if(F.expr("score < q0")).alias("cold"), share("score < q0", "f > 0").alias("cold_up"), F.count_if(F.expr("score >= q3")).alias("hot"), share("score >= q3", "f < 0").alias("hot_down"))


@query("recency_weighted", LAB + ", rw as (select band, fwd, exp(-(max(i) over (partition by symbol) - i) / 108.0) as w from lb where fwd is not null) select band, round(sum(w * fwd) / sum(w), 6) + 0.0 as weighted, round(avg(fwd), 6) + 0.0 as plain, abs(sum(w * fwd) / sum(w) - avg(fwd)) >= 0.01 as drift from rw group by 1", bars=True)
def recency_weighted(spark, sf_dir):
    x = labelled(bars(spark, sf_dir)).where("fwd is not null").withColumn("w", F.exp(-(F.max("i").over(Window.partitionBy("symbol")) - F.col("i")) / 108.0))
    m = F.sum(F.col("w") * F.col("fwd")) / F.sum("w")
    return x.groupBy("band").agg((F.round(m, 6) + 0.0).alias("weighted"), (F.round(F.avg("fwd"), 6) + 0.0).alias("plain"), (F.abs(m - F.avg("fwd")) >= 0.01).alias("drift"))


@query("sentiment_corr", HIST + BANDS + BYH + "select symbol, h::int as h, round(corr(score::double, f), 5) + 0.0 as r from bh where f is not null group by 1, 2", bars=True)
def sentiment_corr(spark, sf_dir):
    x = history(bars(spark, sf_dir))
    return by_horizon(x.join(bands(x), "symbol")).groupBy("symbol", "h").agg((F.round(F.corr("score", "f"), 5) + 0.0).alias("r"))


@query("spearman", LAB + ", rk as (select symbol, (row_number() over (partition by symbol order by score, i))::double as a, (row_number() over (partition by symbol order by round(fwd, 9), i))::double as b from lb where fwd is not null) select symbol, round(corr(a, b), 5) + 0.0 as rho from rk group by 1", bars=True)
def spearman(spark, sf_dir):
    """Correlation of ordinal ranks (ties by time)."""
    x = labelled(bars(spark, sf_dir)).where("fwd is not null")
    rank = lambda c: F.row_number().over(Window.partitionBy("symbol").orderBy(c, "i")).cast("double")
    x = x.select("symbol", rank(F.col("score")).alias("a"), rank(F.round("fwd", 9)).alias("b"))
    return x.groupBy("symbol").agg((F.round(F.corr("a", "b"), 5) + 0.0).alias("rho"))


@query("cross50_accuracy", HIST + f", cx as (select *, lag(score) over ({P}) as s1, lead(close) over ({P}) / close - 1 as nx from hist) select case when score >= 50 then 'up' else 'down' end as cross, count(*) as n, round(avg((case when score >= 50 then nx > 0 else nx < 0 end)::int), 6) as right_next from cx where nx is not null and (score >= 50) <> (s1 >= 50) group by 1", bars=True)
def cross50_accuracy(spark, sf_dir):
    x = history(bars(spark, sf_dir)).withColumns({"s1": F.lag("score").over(by()), "nx": lead("close") / F.col("close") - 1}).where("nx is not null and (score >= 50) <> (s1 >= 50)")
    return x.groupBy(F.when(F.col("score") >= 50, "up").otherwise("down").alias("cross")).agg(F.count("*").alias("n"), F.round(F.avg(F.expr("case when score >= 50 then nx > 0 else nx < 0 end").cast("int")), 6).alias("right_next"))


@query("permutation_test")
def permutation_test(spark, sf_dir):
    """Share of 1,000 seeded shuffles of the returns whose correlation with the score is at least as strong."""
    x = labelled(bars(spark, sf_dir)).where("fwd is not null").select("symbol", "i", "score", "fwd")
    s = x.select("symbol", "i", "score", F.row_number().over(Window.partitionBy("symbol").orderBy("i")).alias("k"))
    perms = x.select("symbol", "fwd", F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("perm"), "i")
    perms = perms.select("symbol", "perm", "fwd", F.row_number().over(Window.partitionBy("symbol", "perm").orderBy(F.xxhash64("i", "perm"))).alias("k"))
    r = perms.join(s, ["symbol", "k"]).groupBy("symbol", "perm").agg(F.corr("score", "fwd").alias("r"))
    real = x.groupBy("symbol").agg(F.corr("score", "fwd").alias("real"))
    return r.join(real, "symbol").groupBy("symbol").agg(F.round(F.avg((F.abs("r") >= F.abs("real")).cast("int")), 4).alias("p_value"))


# -------------------------------------------------------------------------------------------- breadth and today's score
def available_breadth(x: DataFrame, sources: list[str]) -> DataFrame:
    """Adds breadth (the mean of the sources that are not null), used (their number) and sub ((breadth - 0.5) * 2 within -1 and
    1; 0 where there is none)."""
    have = F.array_compact(F.array(*sources))
    x = x.withColumn("used", F.size(have)).withColumn("breadth", F.when(F.col("used") > 0, F.aggregate(have, F.lit(0.0), lambda a, v: a + v) / F.col("used")))
    return x.withColumn("sub", F.when(F.col("used") > 0, clamp((F.col("breadth") - 0.5) * 2, -1.0, 1.0)).otherwise(0.0))


_SOURCES = f""", up as (select symbol, date, i, close > lag(close, 20) over ({P}) as up from bars), so as (select date, case when count(up) >= 3 then avg(up::int) end as own, case when count(up) filter (symbol <> 'N') >= 2 then avg(up::int) filter (symbol <> 'N') end as other from up group by 1),
  ab as (select *, (own is not null)::int + (other is not null)::int as used, (coalesce(own, 0) + coalesce(other, 0)) / nullif((own is not null)::int + (other is not null)::int, 0) as breadth from so)"""


def breadth_sources(b: DataFrame) -> DataFrame:
    """date, own (share of all symbols above 20 bars ago, where three have a bar), other (the same of the others than N, where two
    have one)."""
    x = b.withColumn("up", F.col("close") > F.lag("close", 20).over(by()))
    share = lambda on, least: F.when(F.count(F.when(on, F.col("up"))) >= least, F.avg(F.when(on, F.col("up").cast("int"))))
    return x.groupBy("date").agg(share(F.lit(True), 3).alias("own"), share(F.col("symbol") != "N", 2).alias("other"))


@query("sentiment_breadth", _SOURCES + " select date::varchar as date, used, round(breadth, 6) as breadth, round(case when used > 0 then greatest(-1, least(1, (breadth - 0.5) * 2)) else 0 end, 6) + 0.0 as sub from ab", bars=True)
def sentiment_breadth(spark, sf_dir):
    x = available_breadth(breadth_sources(bars(spark, sf_dir)), ["own", "other"])
    return x.select(F.col("date").cast("string").alias("date"), "used", F.round("breadth", 6).alias("breadth"), (F.round("sub", 6) + F.lit(0.0)).alias("sub"))


_SUBS = ", sb as (select s1.symbol, s1.i, s1.close, ma250, greatest(-1, least(1, (s1.close / c20 - 1) * 100 / 8)) as mom, greatest(-1, least(1, (s1.close / ma250 - 1) / 0.15)) as pos, greatest(-1, least(1, vr / vdiv)) as vol, greatest(-1, least(1, 1 - coalesce(pctile, 50) / 50)) as volat from s1 join pr using (symbol, i))"


@query("sentiment_today", HIST + _SOURCES + _SUBS + ", ls as (select * from sb qualify row_number() over (partition by symbol order by i desc) = 1), ld as (select case when used > 0 then greatest(-1, least(1, (breadth - 0.5) * 2)) else 0 end as sub from ab order by date desc limit 1) select symbol, round(mom, 4) + 0.0 as mom, round(pos, 4) + 0.0 as pos, round(vol, 4) + 0.0 as vol, round(volat, 4) + 0.0 as volat, round(sub, 4) + 0.0 as breadth, floor(greatest(0, least(100, 50 + 50 * (0.30 * mom + 0.20 * pos + 0.20 * vol + 0.15 * volat + 0.15 * sub))) * 10 + 0.5000001)::bigint / 10.0::double as score from ls, ld", bars=True)
def sentiment_today(spark, sf_dir):
    """The five sub-scores of the last bar and their score; breadth from the sources there are on the last date."""
    b = bars(spark, sf_dir)
    x = sub_scores(b).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i")))).where("k = 1")
    now = available_breadth(breadth_sources(b).orderBy(F.desc("date")).limit(1), ["own", "other"]).select("sub")  # one row
    x = x.crossJoin(now)
    total = sum((w * F.col(c) for w, c in zip(WEIGHTS[1:], ("pos", "vol", "volat", "sub"))), WEIGHTS[0] * F.col("mom"))
    r4 = lambda c, name: (F.round(c, 4) + F.lit(0.0)).alias(name)
    return x.select("symbol", *[r4(c, c) for c in ("mom", "pos", "vol", "volat")], r4("sub", "breadth"), (F.floor(clamp(50 + 50 * total, 0.0, 100.0) * 10 + 0.5000001).cast("long") / 10.0).alias("score"))


# ----------------------------------------------------------------------------------------------------- state and maps
LEVEL = "case when score >= 60 then 'high' when score < 40 then 'low' else 'middle' end"
_STATES = HIST + BANDS + f""", st0 as (select *, {LEVEL} as level, score - lag(score, 20) over ({P}) as d20, lead(close, 20) over ({P}) / close - 1 as fwd from hist),
st1 as (select *, case when d20 >= 0 then 'up' else 'down' end as dir from st0), sl as (select * from st1 qualify row_number() over (partition by symbol order by i desc) = 1),
ss as (select l.symbol, l.level, l.dir, count(h.fwd) as n, avg(h.fwd) as fwd, avg((h.fwd >= 0)::int) as pos, count(h.fwd) filter (h.bear = l.bear) as regime_n, avg(h.fwd) filter (h.bear = l.bear) as regime_fwd, avg((h.fwd >= 0)::int) filter (h.bear = l.bear) as regime_pos
  from sl l left join st1 h on h.symbol = l.symbol and h.level = l.level and h.dir = l.dir and h.d20 is not null and h.fwd is not null group by 1, 2, 3)"""


def states(h: DataFrame) -> DataFrame:
    """Per symbol, today's level and direction, and what followed such days, in all and under today's regime."""
    x = h.withColumns({"level": F.expr(LEVEL), "d20": F.col("score") - F.lag("score", 20).over(by()), "fwd": lead("close", 20) / F.col("close") - 1}).withColumn("dir", F.when(F.col("d20") >= 0, "up").otherwise("down"))
    now = x.groupBy("symbol").agg(F.max_by(F.struct("level", "dir", "bear"), "i").alias("t")).select("symbol", "t.level", "t.dir", F.col("t.bear").alias("bear0"))
    y = now.join(x.where("d20 is not null and fwd is not null").select("symbol", "level", "dir", "bear", "fwd"), ["symbol", "level", "dir"], "left")
    same = lambda c: F.when(F.col("bear") == F.col("bear0"), c)
    up = (F.col("fwd") >= 0).cast("int")
    return y.groupBy("symbol", "level", "dir").agg(F.count("fwd").alias("n"), F.avg("fwd").alias("fwd"), F.avg(up).alias("pos"), F.count(same(F.col("fwd"))).alias("regime_n"), F.avg(same(F.col("fwd"))).alias("regime_fwd"), F.avg(same(up)).alias("regime_pos"))


@query("state_signal", _STATES + " select symbol, level, dir, n, round(fwd, 6) as fwd, round(pos, 4) as pos, regime_n, round(regime_fwd, 6) as regime_fwd, round(regime_pos, 4) as regime_pos from ss", bars=True)
def state_signal(spark, sf_dir):
    x = states(history(bars(spark, sf_dir)))
    return x.select("symbol", "level", "dir", "n", F.round("fwd", 6).alias("fwd"), F.round("pos", 4).alias("pos"), "regime_n", F.round("regime_fwd", 6).alias("regime_fwd"), F.round("regime_pos", 4).alias("regime_pos"))


# The horizon with the widest spread (the first, if equal), how many agree with its sign, and what that says: with a positive
# spread cold days were followed by more than hot ones.
_BEST = HIST + BANDS + BYH + """, sp0 as (select symbol, h::int as h, avg(f) filter (score < q1) - avg(f) filter (score >= q2) as spread from bh where f is not null group by 1, 2 having count(*) filter (score < q1) >= 20 and count(*) filter (score >= q2) >= 20),
sp1 as (select symbol, arg_max(h, (abs(spread), -h)) as best, arg_max(spread, (abs(spread), -h)) as spread, count(*) filter (spread > 0) as pos, count(*) as total from sp0 where spread is not null group by 1),
op as (select *, greatest(pos, total - pos) as agree, case when greatest(pos, total - pos) < total * 0.8 then 'divided' when pos * 2 >= total then 'contrarian' else 'momentum' end as verdict from sp1)"""


def best_horizon(x: DataFrame) -> DataFrame:
    """symbol, best, spread, agree, total, verdict of history with bands."""
    part = lambda c: F.avg(F.when(F.expr(c), F.col("f")))
    s = by_horizon(x).groupBy("symbol", "h").agg((part("score < q1") - part("score >= q2")).alias("spread"), F.count_if(F.expr("score < q1")).alias("cold"), F.count_if(F.expr("score >= q2")).alias("hot")).where("cold >= 20 and hot >= 20 and spread is not null")
    top = F.max_by(F.struct("h", "spread"), F.struct(F.abs("spread"), -F.col("h")))
    s = s.groupBy("symbol").agg(top.alias("t"), F.count_if(F.col("spread") > 0).alias("pos"), F.count("*").alias("total"))
    verdict = F.expr("case when greatest(pos, total - pos) < total * 0.8D then 'divided' when pos * 2 >= total then 'contrarian' else 'momentum' end")
    return s.select("symbol", F.col("t.h").alias("best"), F.col("t.spread").alias("spread"), F.greatest("pos", F.col("total") - F.col("pos")).alias("agree"), "total", verdict.alias("verdict"))


@query("horizon_optimum", _BEST + " select symbol, best, round(spread, 6) as spread, agree, total, verdict from op", bars=True)
def horizon_optimum(spark, sf_dir):
    x = history(bars(spark, sf_dir))
    return best_horizon(x.join(bands(x), "symbol")).withColumn("spread", F.round("spread", 6))


TAU = "greatest(10e0, least(80e0, 10 + (best - 5) * 70 / 55e0))"
WIN = "cast(greatest(5e0, least(60e0, floor(10 + (best - 5) * 30 / 55e0 + 0.5e0))) as int)"
_DRIFT = _BEST + f""", dr0 as (select symbol, lead(close, 20) over ({P}) / close - 1 as fwd, exp(-(max(i) over (partition by symbol) - i) / 108.0) as w from hist), dr as (select symbol, abs(sum(w * fwd) / sum(w) - avg(fwd)) >= 0.01 as drift from dr0 where fwd is not null group by 1),
mp as (select op.*, coalesce(drift, false) as drift, {TAU} as tau, {WIN} as win, case when drift then 1.2 else 1.0 end::double as wide, case when drift then 0.35 else 0.5 end::double as cap from op left join dr using (symbol))"""


def parameter_maps(x: DataFrame) -> DataFrame:
    """best_horizon with drift (the recency-weighted mean return is a percent off the plain one), tau (days of reversion), win
    (days of momentum), wide (band), cap (reversion)."""
    d = x.withColumn("fwd", lead("close", 20) / F.col("close") - 1).withColumn("w", F.exp(-(F.max("i").over(Window.partitionBy("symbol")) - F.col("i")) / 108.0)).where("fwd is not null")
    d = d.groupBy("symbol").agg((F.abs(F.sum(F.col("w") * F.col("fwd")) / F.sum(F.when(F.col("fwd").isNotNull(), F.col("w"))) - F.avg("fwd")) >= 0.01).alias("drift"))
    y = best_horizon(x).join(d, "symbol", "left").withColumn("drift", F.coalesce("drift", F.lit(False)))
    return y.withColumns({"tau": F.expr(TAU), "win": F.expr(WIN), "wide": F.expr("case when drift then 1.2D else 1.0D end"), "cap": F.expr("case when drift then 0.35D else 0.5D end")})


@query("parameter_maps", _DRIFT + " select symbol, best, drift, round(tau, 6) as tau, win, wide, cap from mp", bars=True)
def parameter_maps_query(spark, sf_dir):
    x = history(bars(spark, sf_dir))
    return parameter_maps(x.join(bands(x), "symbol")).select("symbol", "best", "drift", F.round("tau", 6).alias("tau"), "win", "wide", "cap")


# ----------------------------------------------------------------------------------------------------------- forecast
_CENTRES = f""", ce0 as (select *, row_number() over (partition by symbol order by i desc) as k from hist), ce1 as (select symbol, arg_max(score, i) as score0, arg_max(bear, i) as bear0 from hist group by 1),
ce as (select h.symbol, any_value(score0) as score0, any_value(bear0) as bear0, avg(score) as center, stddev_pop(score) as std_all, stddev_pop(score) filter (k <= 60) as std60, avg(score) filter (bear = bear0) as regime_center,
  100.0 * count(*) filter (bear = bear0 and k <= 250 and score <= score0) / nullif(count(*) filter (bear = bear0 and k <= 250), 0) as regime_pct, max(score) filter (k = 1) - max(score) filter (k = 21) as d20 from ce0 h join ce1 using (symbol) group by 1)"""


def centres(h: DataFrame) -> DataFrame:
    """symbol, score0, bear0 (today), center, std_all, std60 (of all and of 60 scores), regime_center (mean score under today's
    regime), regime_pct (rank of today's score among the regime's of the last 250 bars), d20."""
    x = h.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i"))))
    x = x.withColumns({"score0": F.max(F.when(F.col("k") == 1, F.col("score"))).over(Window.partitionBy("symbol")), "bear0": F.max(F.when(F.col("k") == 1, F.col("bear"))).over(Window.partitionBy("symbol"))})
    same = F.col("bear") == F.col("bear0")
    near = same & (F.col("k") <= 250)
    return x.groupBy("symbol").agg(
        F.first("score0").alias("score0"), F.first("bear0").alias("bear0"), F.avg("score").alias("center"), F.stddev_pop("score").alias("std_all"), F.stddev_pop(F.when(F.col("k") <= 60, F.col("score"))).alias("std60"), F.avg(F.when(same, F.col("score"))).alias("regime_center"),
        (100.0 * F.count_if(near & (F.col("score") <= F.col("score0"))) / F.nullif(F.count_if(near), F.lit(0))).alias("regime_pct"), (F.max(F.when(F.col("k") == 1, F.col("score"))) - F.max(F.when(F.col("k") == 21, F.col("score")))).alias("d20"),
    )


BASE_STD = "case when std60 is not null then greatest(4e0, least(18e0, 0.6e0 * std60 + 0.4e0 * std_all)) else std_all end"


@query("sentiment_centres", HIST + _CENTRES + f" select symbol, round(center, 6) as center, round(regime_center, 6) as regime_center, round(regime_pct, 4) as regime_pct, round({BASE_STD}, 6) as base_std from ce", bars=True)
def sentiment_centres(spark, sf_dir):
    """Mean scores, of all days and of today's regime, and the deviation that the forecast's band grows from."""
    x = centres(history(bars(spark, sf_dir)))
    return x.select("symbol", F.round("center", 6).alias("center"), F.round("regime_center", 6).alias("regime_center"), F.round("regime_pct", 4).alias("regime_pct"), F.round(F.expr(BASE_STD), 6).alias("base_std"))


# The forecast day by day (idx from 0): the path's own score, drawn to the regime's level, to the centre, out of extremes, and moved by
# what followed such states and by momentum, the near days more than the far ones. No day depends on the day before.
_C = lambda x, lo, hi: f"greatest({lo}e0, least({hi}e0, {x}))"
STEPS = [
    ("mom1", _C("(price / coalesce(lagged, close) - 1) * 100 / 8", -1, 1)), ("ma1", "ma250 + (price - ma250) * (1 - exp(-(idx + 1) / 60e0))"), ("pos1", _C("(price / ma1 - 1) / 0.15e0", -1, 1)), ("fade", "exp(-(idx + 1) / 15e0)"),
    ("raw", _C("50 + 50 * (0.30e0 * mom1 + 0.20e0 * pos1 + 0.20e0 * vol * fade + 0.15e0 * volat * fade + 0.15e0 * sub)", 0, 100)),
    ("mixed", "least(0.6e0, abs(regime_center - center) / 20)"), ("anchor", "center * (1 - mixed) + regime_center * mixed"), ("pull", "0.35e0 * greatest(0.3e0, least(1e0, 1 - abs(regime_pct - 50) / 50))"),
    ("s0", "raw * (1 - pull) + regime_center * pull"), ("revert", "least(1 - exp(-(idx + 1) / tau), cap)"), ("s1", "s0 * (1 - revert) + anchor * revert"),
    ("conf", "greatest(0.5e0, least(1.5e0, 0.5e0 + 2 * (agree / cast(total as double) - 0.5e0)))"), ("trust", "case when verdict = 'contrarian' then 1e0 else 0.5e0 end"),
    ("xw", "case when s1 < q0 and panic is not null then least(1e0, 0.6e0 * conf * trust) * greatest(0e0, panic - 0.5e0) * 2 when s1 > q3 and euphoria is not null then least(1e0, 0.6e0 * conf * trust) * greatest(0e0, euphoria - 0.5e0) * 2 else 0e0 end"),
    ("s2", "s1 * (1 - xw) + anchor * xw"), ("rb", "revert * 0.25e0 * conf"), ("s3", "s2 * (1 - rb) + anchor * rb"),
    ("edge", "case when regime_n >= 20 then (regime_pos - 0.5e0) * 2 when n >= 20 then (pos_all - 0.5e0) * 2 else 0e0 end"), ("s4", _C("s3 + edge * 0.15e0 * conf * 12 * fade", 0, 100)), ("s5", _C("s4 + greatest(-1e0, least(1e0, coalesce(d20, 0e0) / 10)) * 8 * fade", 0, 100)),
    ("score", "floor(s5 * 10 + 0.5000001e0) / 10e0"), ("rough", "case when std_path > 1e-12 and std_near is not null then greatest(1e0, least(1.6e0, 1 + (std_near / std_path - 1) * 0.5e0)) else 1e0 end"),
    ("half", f"greatest(1e0, least(14e0, {BASE_STD} * sqrt((idx + 1) / 20e0) * 0.8e0 * case when bear0 then 1.15e0 else 1e0 end * wide * rough))"),
    ("lo", "greatest(0e0, score - half)"), ("hi", "least(100e0, score + half)"),
]
_EXTREMES = f", xt as (select h.symbol, avg((fwd > 0)::int) filter (score < q0) as panic, avg((fwd < 0)::int) filter (score >= q3) as euphoria from (select *, lead(close, 20) over ({P}) / close - 1 as fwd from hist) h join bd using (symbol) where fwd is not null group by 1)"


def forecast_path(b: DataFrame) -> DataFrame:
    """symbol, idx, date, price: the base path of the wave plan day by day, on weekdays after the last bar."""
    from .plan import _A, along, spark_rows, wave_labels
    from .waves import zigzag

    x = wave_labels(b, zigzag(b))
    p = along(spark_rows(x, _A).where("path = 'base'"), ["symbol", "path"], 1).where("t >= 1").join(x.select("symbol", F.col("last").alias("last_")), "symbol")
    p = p.withColumn("date", F.date_add("last_", F.col("t"))).where("weekday(date) < 5")
    return p.select("symbol", (F.row_number().over(Window.partitionBy("symbol").orderBy("t")) - 1).alias("idx"), "date", "price")


def _path_sql() -> str:
    from .plan import _A, _AT, LABELS, sql_rows

    return LABELS + ", fa as (" + sql_rows("wp", [r for r in _A if r["path"] == "'base'"]) + f"), fg as (select symbol, t as t0, v, lead(t) over w as t1, lead(v) over w as v1, max(t) over (partition by symbol) as last_ from fa window w as (partition by symbol order by t)), ft as (select unnest(generate_series(1, 360))::int as t), fp0 as (select symbol, t, {_AT} as price from fg join ft on t >= t0 and (t < t1 or (t = t1 and t1 = last_)) where t1 is not null), fp as materialized (select p.symbol, (row_number() over (partition by p.symbol order by t) - 1)::int as idx, (w.last + t)::date as date, price from fp0 p join wp w using (symbol) where dayofweek(w.last + t) between 1 and 5)"


def forecast(b: DataFrame) -> DataFrame:
    """symbol, idx, date, score, lo, hi of every day of the path."""
    h = kept(history(b))
    x = kept(h.join(bands(h), "symbol"))
    now = available_breadth(breadth_sources(b).orderBy(F.desc("date")).limit(1), ["own", "other"]).select("sub")  # one row
    last_ = sub_scores(b).groupBy("symbol").agg(F.max_by(F.struct("close", "ma250", "vol", "volat"), "i").alias("l")).select("symbol", "l.*")
    ext = x.withColumn("fwd", lead("close", 20) / F.col("close") - 1).where("fwd is not null").groupBy("symbol").agg(F.avg(F.when(F.expr("score < q0"), (F.col("fwd") > 0).cast("int"))).alias("panic"), F.avg(F.when(F.expr("score >= q3"), (F.col("fwd") < 0).cast("int"))).alias("euphoria"))
    s = states(h).select("symbol", "n", F.col("pos").alias("pos_all"), "regime_n", "regime_pos")
    one = centres(h).join(parameter_maps(x), "symbol").join(bands(h), "symbol").join(last_, "symbol").join(ext, "symbol", "left").join(s, "symbol").crossJoin(now)
    w = Window.partitionBy("symbol").orderBy("idx")
    p = forecast_path(b).withColumn("nxt", F.lead("price").over(w) / F.col("price") - 1)
    p = p.withColumns({"std_path": F.stddev_pop("nxt").over(Window.partitionBy("symbol")), "std_near": F.stddev_pop("nxt").over(w.rowsBetween(-19, 0))}).join(one, "symbol")
    back = p.select("symbol", F.col("idx").alias("idx_"), F.col("price").alias("lagged"))
    y = p.withColumn("idx_", F.col("idx") - F.col("win")).join(back, ["symbol", "idx_"], "left")
    for name, e in STEPS:
        y = y.withColumn(name, F.expr(e))
    return y.select("symbol", "idx", "date", "score", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def _steps_sql(source: str) -> str:
    out = source
    for k, (name, e) in enumerate(STEPS):
        out = f"(select *, {e} as {name} from {out}) z{k}"
    return out


def _forecast_sql() -> str:
    from .waves import zsql

    join = """, fj as (select fp.symbol, fp.idx, fp.date, fp.price, ce.score0, bear0, center, std_all, std60, regime_center, regime_pct, d20, agree, total, verdict, tau, win, wide, cap, q0, q1, q2, q3, ls.close, ma250, vol, volat, panic, euphoria, ss.n, ss.pos as pos_all, regime_n, regime_pos, ld.sub,
  lead(price) over (partition by fp.symbol order by idx) / price - 1 as nxt from fp join ce using (symbol) join mp using (symbol) join bd using (symbol) join ls using (symbol) left join xt using (symbol) join ss using (symbol), ld),
fk as (select *, stddev_pop(nxt) over (partition by symbol) as std_path, stddev_pop(nxt) over (partition by symbol order by idx rows between 19 preceding and current row) as std_near from fj),
fl as (select a.*, b.price as lagged from fk a left join fp b on b.symbol = a.symbol and b.idx = a.idx - a.win)"""
    parts = _path_sql() + _STATES + _DRIFT[len(HIST + BANDS):] + _SOURCES + _SUBS + _CENTRES + _EXTREMES
    parts += ", ls as (select * from sb qualify row_number() over (partition by symbol order by i desc) = 1), ld as (select case when used > 0 then greatest(-1, least(1, (breadth - 0.5) * 2)) else 0 end as sub from ab order by date desc limit 1)"
    return zsql(parts + join + f" select symbol, idx, date::varchar as date, score, round(lo, 4) as lo, round(hi, 4) as hi from {_steps_sql('fl')}")


@query("sentiment_path", None)
def sentiment_path(spark, sf_dir):
    """The path that the forecast follows: trading days between the plan's anchors, joined by straight lines."""
    return forecast_path(bars(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


@query("sentiment_forecast", None)
def sentiment_forecast(spark, sf_dir):
    return forecast(bars(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


def _register_sql() -> None:
    from .waves import zsql

    ORACLES["sentiment_path"] = zsql(_path_sql() + " select symbol, idx, date::varchar as date, price from fp")
    ORACLES["sentiment_forecast"] = _forecast_sql()


_register_sql()


# ----------------------------------------------------------------------------------------------------- weight search
SETS, SETS_A_TASK, TOP, TRAIN = 6_000, 250, 10, 0.7
WINDOWS = (10, 20, 30, 40)
#: Steps of the rule that makes the weights, one for each sub-score that has a free weight.
STEPS_OF_WEIGHTS = (31, 53, 71, 89)


def weight_sets(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (momentum, position, volume, volatility, breadth) and momentum windows of the sets first to last: four free
    weights between 0.05 and 0.5 by an arithmetic rule, so that every run tries the same sets, the fifth is what is left."""
    k = np.arange(first, last + 1)
    raw = np.stack([0.05 + 0.45 * ((k * m + m // 7) % 997) / 997 for m in STEPS_OF_WEIGHTS], 1)
    total = raw.sum(1, keepdims=True)
    w = np.where(total < 0.95, np.hstack([raw, np.maximum(0.05, 1 - total)]), np.hstack([raw * 0.95 / total, np.full_like(total, 0.05)]))
    return w / w.sum(1, keepdims=True), np.array(WINDOWS)[k % len(WINDOWS)]


def rank_correlations(scores: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Spearman's coefficient of each column of scores with ahead; equal values rank in order of time. 0 below ten rows."""
    n = len(ahead)
    if n < 10:
        return np.zeros(scores.shape[1])
    ranks = np.empty(scores.shape)
    np.put_along_axis(ranks, np.argsort(scores, axis=0, kind="stable"), np.arange(n, dtype=float)[:, None], axis=0)
    own = np.empty(n)
    own[np.argsort(ahead, kind="stable")] = np.arange(n)
    middle = (n - 1) / 2
    return (ranks - middle).T @ (own - middle) / (n * (n * n - 1) / 12)


def searched(x: DataFrame, sets: int = SETS, a_task: int = SETS_A_TASK) -> DataFrame:
    """symbol, k, span, r_train, r_test, n_train, n_test, weights: of all sets of weights, the ten of each symbol whose score goes
    most against the next 20 bars in the first 70 percent of the bars, with their coefficient in the rest. A task takes a block
    of sets through one matrix product and gives back its best ten; x has mom10 .. volat and fwd."""
    columns = ["mom10", "mom", "mom30", "mom40", "pos", "vol", "volat"]

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        first = int(key[1]) * a_task + 1
        w, span = weight_sets(first, min(sets, first + a_task - 1))
        momentum = p[columns[:4]].to_numpy()[:, np.searchsorted(WINDOWS, span)]
        scores = np.clip(50 + 50 * (momentum * w[:, 0] + p[columns[4:]].to_numpy() @ w[:, 1:4].T), 0, 100)
        ahead, cut = p["fwd"].to_numpy(), int(len(p) * TRAIN)
        train, test = rank_correlations(scores[:cut], ahead[:cut]), rank_correlations(scores[cut:], ahead[cut:])
        best = [j for j in np.argsort(train, kind="stable")[:TOP] if train[j] < 0]
        # a block where no set goes against the next bars has no row; a column of lists is then still one of objects
        lists = pd.Series([w[j].tolist() for j in best], dtype=object)
        return pd.DataFrame({"symbol": key[0], "k": [first + int(j) for j in best], "span": [int(span[j]) for j in best], "r_train": train[best], "r_test": test[best], "n_train": cut, "n_test": len(p) - cut, "weights": lists})

    x = x.select("symbol", "i", "fwd", *columns).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((sets - 1) // a_task))))
    found = x.groupBy("symbol", "block").applyInPandas(run, "symbol string, k int, span int, r_train double, r_test double, n_train int, n_test int, weights array<double>")
    order = Window.partitionBy("symbol").orderBy("r_train", "k")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP)


def search_rows(b: DataFrame) -> DataFrame:
    return sub_scores(b, WINDOWS, 0.5).withColumn("fwd", (lead("close", 20) / F.col("close") - 1) * 100).where("fwd is not null")


@query("weight_search")
def weight_search(spark, sf_dir):
    """All 6,000 sets of weights with four momentum windows, by rank correlation, chosen on the first 70 percent of the bars and
    shown on the rest. A test holds it against plain ranks; SQL would sort every series 12,000 times."""
    x = searched(kept(search_rows(bars(spark, sf_dir))))
    return x.select("symbol", "place", "k", "span", F.round("r_train", 6).alias("r_train"), F.round("r_test", 6).alias("r_test"), "n_train", "n_test")
