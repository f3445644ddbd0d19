"""Reports over the structure and the probabilities: back-tests of buy and sell points, roll-ups and verdicts, projections with
their bands, comparisons of volatility estimates, and combined signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by, clamp, finite, first_passage_sql, last, normal_cdf_sql, r6, std, with_total
from ..functions.isotonic import looked_up, pools
from ..plans.registry import BARS_SQL, query
from ..sources.bars import bars, table
from ..sources.shared import kept
from .alignment import BREADTH
from .indicators import _EW, RET, closing_bars, ewma_sigma, rsi_columns, sql_ema, sql_last, with_returns
from .plan import LABELS, wave_labels
from .probability import AMPLITUDES, EVAL, HORIZONS, banded, evaluate, target_log
from .strokes import ALL, DAY, POINTS, Structure, completed, divergences, points, scenario_sql, scenarios, spans, sql, strokes, zones
from .waves import ABC, IMPULSE, LEGS, SIX, SWINGS, impulses, legs, pw, swings, zigzag, zsql

P = "partition by symbol order by i"
HS = (5, 10, 20, 60)


# --------------------------------------------------------------------------------------- back-test of buy and sell points
def dated_points(b: DataFrame, of: Structure | None = None) -> DataFrame:
    """Points with i1, the bar at which their stroke ends."""
    s = spans(strokes(b), b) if of is None else of.strokes
    z = zones(s) if of is None else of.zones
    return points(s, z, divergences(s, z) if of is None else of.divergences).join(completed(s).select("symbol", "no", "i1"), ["symbol", "no"])


def outcomes(b: DataFrame, of: Structure | None = None) -> DataFrame:
    """symbol, kind, signal, i1, h, ret, win of every point but the latest of its kind: the return of the next h bars, and
    whether it went the point's way."""
    p = dated_points(b, of)
    k = F.row_number().over(Window.partitionBy("symbol", "kind", "signal").orderBy(F.desc("no"), F.desc("anchor")))
    p = p.withColumn("k", k).where("k > 1")
    fwd = b.withColumns({f"f{h}": F.lead("close", h).over(by()) / F.col("close") - 1 for h in HS})
    fwd = fwd.select("symbol", F.col("i").alias("i1"), F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"f{h}").alias("ret")) for h in HS])).alias("x")).select("symbol", "i1", "x.*")
    return p.join(fwd, ["symbol", "i1"]).where("ret is not null").select("symbol", "kind", "signal", "i1", "h", "ret", (F.col("ret") * F.col("signal") > 0).cast("int").alias("win"))


OUT = POINTS + f""", ox as (select p.symbol, p.kind, p.signal, s.i1, row_number() over (partition by p.symbol, p.kind, p.signal order by p.no desc, p.anchor desc) as k from pt p join dn s on s.symbol = p.symbol and s.no = p.no),
of as (select symbol, i, h::int as h, lead(close, h::int) over (partition by symbol, h order by i) / close - 1 as ret from bars, (select unnest({list(HS)}) as h)),
oc as materialized (select ox.symbol, kind, signal, i1, h, ret, (ret * signal > 0)::int as win from ox join of on of.symbol = ox.symbol and of.i = ox.i1 where k > 1 and ret is not null)"""


@query("point_backtest", sql("select symbol, kind, signal::int as signal, h, count(*) as n, round(avg(win), 6) as win, round(avg(ret), 6) + 0.0 as ret from oc group by 1, 2, 3, 4", ALL + OUT))
def point_backtest(spark, sf_dir):
    """Number, share of wins and mean return of every kind of point, for each symbol and horizon."""
    return outcomes(kept(bars(spark, sf_dir))).groupBy("symbol", "kind", "signal", "h").agg(F.count("*").alias("n"), F.round(F.avg("win"), 6).alias("win"), (F.round(F.avg("ret"), 6) + F.lit(0.0)).alias("ret"))


@query("backtest_rollup", sql("select kind, signal::int as signal, h, sum(n)::bigint as n, round(sum(win * n) / sum(n), 6) as win, round(sum(ret * n) / sum(n), 6) + 0.0 as ret from (select symbol, kind, signal, h, count(*) as n, avg(win) as win, avg(ret) as ret from oc group by 1, 2, 3, 4) group by 1, 2, 3", ALL + OUT))
def backtest_rollup(spark, sf_dir):
    """The same over all symbols, weighed by the number of points."""
    x = outcomes(kept(bars(spark, sf_dir))).groupBy("symbol", "kind", "signal", "h").agg(F.count("*").alias("n"), F.avg("win").alias("win"), F.avg("ret").alias("ret"))
    w = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return x.groupBy("kind", "signal", "h").agg(F.sum("n").alias("n"), F.round(w("win"), 6).alias("win"), (F.round(w("ret"), 6) + F.lit(0.0)).alias("ret"))


VERDICT = "case when early is null or recent is null then 'unknown' when (recent - early) * 100 <= -15 then 'decayed' when (recent - early) * 100 >= -5 then 'stable' else 'slightly decayed' end"


def robustness(o: DataFrame, n: DataFrame) -> DataFrame:
    """symbol, kind, signal, h, early and recent (shares of wins before and after splits at 40, 50 and 60 percent of the bars, summed
    over the splits)."""
    x = o.where("h > 5").join(n, "symbol").withColumn("split", F.explode(F.array(F.lit(40), F.lit(50), F.lit(60)))).withColumn("old", 100 * F.col("i1") < F.col("split") * F.col("n"))
    part = lambda on: F.avg(F.when(F.col("old") == on, F.col("win")))
    return x.groupBy("symbol", "kind", "signal", "h").agg(part(True).alias("early"), part(False).alias("recent"))


_ROB = ", on_ as (select symbol, max(i) + 1 as n from bars group by 1), ro as (select oc.symbol, kind, signal, h, avg(win) filter (100 * i1 < s * n) as early, avg(win) filter (100 * i1 >= s * n) as recent from oc join on_ using (symbol), (select unnest([40, 50, 60]) as s) where h > 5 group by 1, 2, 3, 4)"


@query("point_robustness", sql("select symbol, round(avg(early), 4) as early_rate, round(avg(recent), 4) as recent_rate, round(avg(recent) - avg(early), 4) + 0.0 as decay from ro group by 1", ALL + OUT + _ROB))
def point_robustness(spark, sf_dir):
    """Mean share of wins over kinds and horizons, before and after the splits."""
    b = bars(spark, sf_dir)
    r = robustness(outcomes(b), b.groupBy("symbol").agg((F.max("i") + 1).alias("n")))
    return r.groupBy("symbol").agg(F.round(F.avg("early"), 4).alias("early_rate"), F.round(F.avg("recent"), 4).alias("recent_rate"), (F.round(F.avg("recent") - F.avg("early"), 4) + F.lit(0.0)).alias("decay"))


@query("robustness_verdict", sql(f"select symbol, {VERDICT} as verdict from (select symbol, coalesce(max(early) filter (kind = 1), max(early) filter (kind = 3)) as early, coalesce(max(recent) filter (kind = 1), max(recent) filter (kind = 3)) as recent from ro where h = 20 and signal = 1 group by 1)", ALL + OUT + _ROB))
def robustness_verdict(spark, sf_dir):
    """What the change of the win rate of buys (kind 1, else 3) after 20 bars says."""
    b = bars(spark, sf_dir)
    r = robustness(outcomes(b), b.groupBy("symbol").agg((F.max("i") + 1).alias("n"))).where("h = 20 and signal = 1")
    pick = lambda c: F.coalesce(F.max(F.when(F.col("kind") == 1, F.col(c))), F.max(F.when(F.col("kind") == 3, F.col(c)))).alias(c)
    return r.groupBy("symbol").agg(pick("early"), pick("recent")).selectExpr("symbol", f"{VERDICT} as verdict")


@query("win_rate_interval", sql("select kind, signal::int as signal, h, count(*) as n, round(greatest(0, avg(win) - 1.96 * sqrt(avg(win) * (1 - avg(win)) / count(*))), 6) as lo, round(least(1, avg(win) + 1.96 * sqrt(avg(win) * (1 - avg(win)) / count(*))), 6) as hi from oc group by 1, 2, 3", ALL + OUT))
def win_rate_interval(spark, sf_dir):
    """95 percent interval of the share of wins."""
    x = outcomes(kept(bars(spark, sf_dir))).groupBy("kind", "signal", "h").agg(F.count("*").alias("n"), F.avg("win").alias("p"))
    half = 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return x.select("kind", "signal", "h", "n", F.round(F.greatest(F.lit(0.0), F.col("p") - half), 6).alias("lo"), F.round(F.least(F.lit(1.0), F.col("p") + half), 6).alias("hi"))


@query("overall_kpis", sql("select count(*) as symbols, round(avg(strokes), 4) as strokes, round(avg(zones), 4) as zones, round(avg(polarity), 4) + 0.0 as polarity, round(avg((trend = 'up')::int), 4) as rising from sc", scenario_sql()))
def overall_kpis(spark, sf_dir):
    """Means over all symbols."""
    x = scenarios(kept(bars(spark, sf_dir)))
    return x.agg(F.count("*").alias("symbols"), F.round(F.avg("strokes"), 4).alias("strokes"), F.round(F.avg("zones"), 4).alias("zones"), (F.round(F.avg("polarity"), 4) + F.lit(0.0)).alias("polarity"), F.round(F.avg((F.col("trend") == "up").cast("int")), 4).alias("rising"))


# --------------------------------------------------------------------------------------------------------- projection
#: Horizon and widening of the bands.
H, KAPPA = 30, 1.8
_Q = "select symbol, close, m, q5, q25, q50, q75, q95"
_DIST = f""", pj0 as (select symbol, i, close, max(i) over (partition by symbol) as n, ln(lead(close, {H}) over ({P}) / close) as f from bars), pj as (select symbol, arg_max(close, i) as close, avg(f) filter (i >= n - {3 * 244 + H} + 1) as m, quantile_cont(f, 0.05) filter (i >= n - {3 * 244 + H} + 1) as q5, quantile_cont(f, 0.25) filter (i >= n - {3 * 244 + H} + 1) as q25,
  quantile_cont(f, 0.5) filter (i >= n - {3 * 244 + H} + 1) as q50, quantile_cont(f, 0.75) filter (i >= n - {3 * 244 + H} + 1) as q75, quantile_cont(f, 0.95) filter (i >= n - {3 * 244 + H} + 1) as q95 from pj0 group by 1)"""


def distribution(b: DataFrame, h: int = H) -> DataFrame:
    """symbol, close, m, q5..q95: mean and quantiles of the log returns of h bars that begin in the last three years."""
    x = b.withColumns({"f": F.ln(F.lead("close", h).over(by()) / F.col("close")), "n": F.max("i").over(Window.partitionBy("symbol"))})
    near = F.when(F.col("i") >= F.col("n") - (3 * 244 + h) + 1, F.col("f"))
    q = x.groupBy("symbol").agg(F.max_by("close", "i").alias("close"), F.avg(near).alias("m"), F.percentile(near, [0.05, 0.25, 0.5, 0.75, 0.95]).alias("q"))
    return q.select("symbol", "close", "m", *[F.col("q")[k].alias(f"q{p}") for k, p in enumerate((5, 25, 50, 75, 95))])


def _edge(q: str) -> str:
    """A band's edge at share f of the horizon."""
    return f"close * exp(m * f + (q{q} - q50) * {KAPPA}e0 * sqrt(f))"


_GRID = f"round(close * exp(m * f), 4) as mid, round({_edge('5')}, 4) as lo95, round({_edge('95')}, 4) as hi95, round({_edge('25')}, 4) as lo75, round({_edge('75')}, 4) as hi75"


@query("projection_grid", _DIST + f" select symbol, k, cast(floor(f * {H} + 0.5e0) as int) as t, {_GRID} from (select pj.*, k::int as k, k / 100e0 as f from pj, (select unnest(generate_series(0, 100)) as k))", bars=True)
def projection_grid(spark, sf_dir):
    """101 points over the horizon: mean path and the bands around it, wider with the root of time, each side by its own
    quantile."""
    x = distribution(bars(spark, sf_dir)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(100)))).withColumn("f", F.col("k") / 100.0)
    return x.selectExpr("symbol", "k", f"cast(floor(f * {H} + 0.5e0) as int) as t", *_GRID.split(", round")[0:1], *["round" + p for p in _GRID.split(", round")[1:]])


@query("key_horizons", _DIST + f", kg as (select symbol, t, close * exp(m * f) as mid, {_edge('5')} as lo, {_edge('95')} as hi from (select pj.*, t::int as t, t / {H}e0 as f from pj, (select unnest(generate_series(0, {H})) as t))) select symbol, 'key' as what, t, round(mid, 4) as mid, round(lo, 4) as lo, round(hi, 4) as hi from kg where t in (8, 15, 20, 30) union all select symbol, 'dip', arg_min(t, (lo, t)), round(arg_min(mid, (lo, t)), 4), round(min(lo), 4), round(arg_min(hi, (lo, t)), 4) from kg group by 1 union all select symbol, 'tail', t, round(mid, 4), round(lo, 4), round(hi, 4) from kg where t = {H}", bars=True)
def key_horizons(spark, sf_dir):
    """The projection at 8, 15, 20 and 30 bars, where its lower edge is lowest, and at its end."""
    x = distribution(bars(spark, sf_dir)).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(H)))).withColumn("f", F.col("t") / float(H))
    g = x.selectExpr("symbol", "t", "close * exp(m * f) as mid", f"{_edge('5')} as lo", f"{_edge('95')} as hi")
    r = lambda f, what: f.select("symbol", F.lit(what).alias("what"), "t", *[F.round(c, 4).alias(c) for c in ("mid", "lo", "hi")])
    dip = g.groupBy("symbol").agg(F.min_by(F.struct("t", "mid", "lo", "hi"), F.struct("lo", "t")).alias("d")).select("symbol", "d.*")
    return r(g.where("t in (8, 15, 20, 30)"), "key").union(r(dip, "dip")).union(r(g.where(F.col("t") == H), "tail"))


_HOLD0 = "ln(zd / close)"
_HOLD1 = f"1.645e0 * (m - {_HOLD0}) / (case when {_HOLD0} >= m then (q95 - q50) * {KAPPA}e0 else (q50 - q5) * {KAPPA}e0 end)"
_HOLD = f"greatest(0.01e0, least(0.99e0, {normal_cdf_sql('d')}))"


@query("survival_probability", sql(f"select symbol, round({_HOLD}, 6) as hold from (select symbol, {_HOLD1} as d from pj join (select symbol, zd from sc where zd is not null) using (symbol))", scenario_sql() + _DIST))
def survival_probability(spark, sf_dir):
    """Chance that the price stays above the last zone's lower edge, by the projection's own bands, each side for itself."""
    b = bars(spark, sf_dir)
    x = distribution(b).join(scenarios(b).where("zd is not null").select("symbol", "zd"), "symbol")
    return x.selectExpr("symbol", f"{_HOLD1} as d").selectExpr("symbol", f"round({_HOLD}, 6) as hold")


# ----------------------------------------------------------------------------------------------- volatility estimates
def _samples_with(name: str) -> str:
    return f"case when (1 - bar) * dir >= 0 then 1e0 else greatest(0.001e0, least(0.999e0, {first_passage_sql('ln(bar)', '0e0', name, 'h')})) end"


BAKE_H, BAKE_R = HORIZONS, AMPLITUDES
#: v: the exponentially weighted variance; it returns to that of 250 bars, lv, by 3 percent a bar.
ESTIMATES = {"rolling": "s20", "parkinson": "pk", "blend": "sqrt(s20 * pk)", "long": "s120", "weighted": "sqrt(v)", "reverting": "sqrt(lv + (v - lv) * (1 - power(0.97e0, h0)) / (h0 * 0.03e0))"}
_AHEAD = ", ".join(f"max(high) over ({P} rows between 1 following and {h} following) as hi{h}, min(low) over ({P} rows between 1 following and {h} following) as lo{h}" for h in BAKE_H)
_PICKH = lambda k: "case " + " ".join(f"when h0 = {h} then {k}{h}" for h in BAKE_H) + " end"
_BAKE = _EW.replace("{ret}", RET).replace("{bars}", BARS_SQL) + f""", bk0 as (select rt.*, ew.v, {sql_last('var_samp', 'ret', 250)} as lv, {sql_last('stddev_samp', 'ret', 20)} as s20, {sql_last('stddev_samp', 'ret', 120)} as s120, sqrt({sql_last('avg', 'power(ln(high / low), 2)', 20)} / (4 * ln(2.0))) as pk, max(i) over (partition by symbol) as n, {_AHEAD} from rt left join ew using (symbol, i)),
bk1 as (select symbol, close, h0, h0::double as h, r::double as r, dir, {_PICKH('hi')} / close as hi, {_PICKH('lo')} / close as lo, unnest([{', '.join(f"{{'name': '{k}', 'sigma': {v}}}" for k, v in ESTIMATES.items())}]) as e from bk0, (select unnest({list(BAKE_H)})::int as h0), (select unnest({list(BAKE_R)}) as r), (select unnest([1, -1]) as dir) where i >= 250 and i + {max(BAKE_H)} <= n),
bk2 as (select *, e.name as name, e.sigma as sigma, 1 + dir * r as bar from bk1 where e.sigma > 0), bk as (select name, h0 as h, {_samples_with('sigma')} as p, (case when dir = 1 then hi >= bar else lo <= bar end)::int as y from bk2)"""


@query("volatility_bakeoff", _BAKE + " select name, h, count(*) as n, round(avg(power(p - y, 2)), 5) as brier from bk group by grouping sets ((name), (name, h))")
def volatility_bakeoff(spark, sf_dir):
    """Brier scores of first-passage chances without drift over the whole grid of horizons and amplitudes, with six estimates of
    the deviation: 20 bars, 120 bars, from ranges, the geometric mean of closes and ranges, exponentially weighted, and that one
    returning to its long mean."""
    b = with_returns(bars(spark, sf_dir))
    lv = F.var_samp("ret").over(last(250))
    b = ewma_sigma(b.drop("ret", "simple"), b.columns).withColumns({"v": F.col("sigma") * F.col("sigma"), "lv": F.when(F.count("ret").over(last(250)) == 250, lv)})
    pk = F.sqrt(F.when(F.count("*").over(last(20)) == 20, F.avg(F.pow(F.ln(F.col("high") / F.col("low")), 2)).over(last(20))) / (4 * F.ln(F.lit(2.0))))
    x = b.withColumns({"s20": std("ret", 20), "s120": std("ret", 120), "pk": pk, "n": F.max("i").over(Window.partitionBy("symbol"))} | {f"{c}{h}": f(k).over(by().rowsBetween(1, h)) for h in BAKE_H for c, f, k in (("hi", F.max, "high"), ("lo", F.min, "low"))}).where(f"i >= 250 and i + {max(BAKE_H)} <= n")
    x = x.select("close", F.explode(F.array(*[F.struct(F.lit(h).alias("h0"), (F.col(f"hi{h}") / F.col("close")).alias("hi"), (F.col(f"lo{h}") / F.col("close")).alias("lo")) for h in BAKE_H])).alias("a"), *[c for c in ("s20", "s120", "pk", "v", "lv")]).select("a.*", "s20", "s120", "pk", "v", "lv")
    x = x.select("h0", "hi", "lo", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.expr(v).alias("sigma")) for k, v in ESTIMATES.items()])).alias("e")).where("e.sigma > 0").select("*", F.explode(F.array(*[F.struct(F.lit(1 + d * r).alias("bar"), F.lit(d).alias("dir")) for r in BAKE_R for d in (1, -1)])).alias("g"))
    x = x.selectExpr("e.name as name", "h0", "cast(h0 as double) as h", "hi", "lo", "g.bar as bar", "g.dir as dir", "e.sigma as sigma").selectExpr("name", "h0 as h", f"{_samples_with('sigma')} as p", "cast(case when dir = 1 then hi >= bar else lo <= bar end as int) as y")
    return x.groupingSets([["name"], ["name", "h"]], "name", "h").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 5).alias("brier"))


# --------------------------------------------------------------------------------------------------------- time model
TIME_R = (0.05, 0.08, 0.12, 0.15, 0.20)
#: Anchors: from the first bar with a year behind it, every 15th bar with a whole window ahead of it.
TIME_FIRST, TIME_STEP, TIME_AHEAD = 250, 15, 330
TIME_AT = f"i >= {TIME_FIRST} and (i - {TIME_FIRST}) % {TIME_STEP} = 0 and i + {TIME_AHEAD} <= n"
_TIME = LEGS + f""", tm0 as (select symbol, count(*) as legs, median(days / abs(ret)) as pace from legs where ret > 0 group by 1 having count(*) >= 4),
tm1 as (select b.symbol, b.i, r::double as r, ln(1 + r) * pace as pred, (select min(c.i) from bars c where c.symbol = b.symbol and c.i > b.i and c.i <= b.i + 330 and c.high >= b.close * (1 + r)) - b.i as actual from (select *, max(i) over (partition by symbol) as n from bars) b join tm0 using (symbol), (select unnest({list(TIME_R)}) as r) where {TIME_AT})"""


@query("time_model_error", zsql(_TIME + " select r, count(*) as n, round(avg(abs(pred - actual) / actual), 4) as mape, round(avg(pred - actual), 4) + 0.0 as bias from tm1 where actual is not null group by grouping sets ((r), ())"))
def time_model_error(spark, sf_dir):
    """Days to a rise of r, by the median pace of past legs, against the first bar that reached it within 330 bars; anchors are
    every 15th bar, as the study takes them, from the 250th to the last one with 330 bars ahead. Bars that never reach it are
    left out."""
    x = time_records(kept(bars(spark, sf_dir)))
    return with_total(x, [["r"]], F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("days")) / F.col("days")), 4).alias("mape"), (F.round(F.avg(F.col("pred") - F.col("days")), 4) + F.lit(0.0)).alias("bias"))


def time_records(b: DataFrame) -> DataFrame:
    """symbol, i, r, pred, days of the anchors that reach a rise of r within the window."""
    pace = legs(zigzag(b)).where("ret > 0").groupBy("symbol").agg(F.count("*").alias("legs"), F.median(F.col("days") / F.col("ret")).alias("pace")).where("legs >= 4")
    log = b.withColumn("n", F.max("i").over(Window.partitionBy("symbol"))).where(TIME_AT).join(pace, "symbol").select("symbol", "i", "pace", "close", F.explode(F.array(*[F.lit(r) for r in TIME_R])).alias("r"))
    log = log.select("symbol", "i", "r", F.expr("ln(1 + r) * pace").alias("pred"), F.lit("sell").alias("side"), F.expr("close * (1 + r)").alias("price"), F.lit(TIME_AHEAD).alias("expect"), F.lit(0.0).alias("frac"))
    return evaluate(log, b).where(f"days is not null and days <= {TIME_AHEAD}").select("symbol", "i", "r", "pred", "days")


def time_calibrated(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of time records, the steps fitted on the first 60 percent of each symbol's (by anchor), and the others with `cal`."""
    at = F.row_number().over(Window.partitionBy("symbol").orderBy("i", "r"))
    x = kept(x.withColumn("train", at <= F.floor(F.count("*").over(Window.partitionBy("symbol")) * 0.6)))
    steps = kept(pools(x.where("train"), F.col("pred"), F.col("days")))
    return steps, looked_up(x.where("not train").drop("train"), "pred", steps, "cal")


@query("time_calibration")
def time_calibration(spark, sf_dir):
    """Whether isotonic regression of the days on the predicted days, fitted on the first 60 percent, brings the error of the rest
    down by a tenth. A test restates it plainly; SQL has no pooling."""
    steps, x = time_calibrated(time_records(kept(bars(spark, sf_dir))))
    error = lambda c: F.avg(F.abs(F.col(c) - F.col("days")) / F.col("days"))
    x = x.groupBy("symbol").agg(F.count("*").alias("n"), error("pred").alias("before"), error("cal").alias("after"))
    x = x.join(steps.groupBy("symbol").agg(F.count("*").alias("steps")), "symbol")
    return x.select("symbol", "n", "steps", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), F.expr("case when after < before * 0.9 then 'improves' else 'no gain' end").alias("verdict"))


# --------------------------------------------------------------------------------------------------- production Brier
@query("production_brier", EVAL + f""", pb as (select e.key, e.side, e.expect, case e.expect when 20 then t.s20 when 60 then t.s60 else t.s120 end as sigma, e.price / t.close as bar, (e.days <= e.expect)::int as hit, e.state from ev2 e join term t on t.symbol = e.symbol and t.i = e.i),
  pp as (select key, coalesce(hit, 0) as y, case when (1 - bar) * case when side = 'sell' then 1 else -1 end >= 0 then 1.0 else {first_passage_sql('ln(bar)', '0e0', 'sigma', 'expect::double')} end as p from pb where state <> 'pending' and sigma > 0)
  select key, count(*) as n, round(avg(power(p - y, 2)), 5) as brier, round(avg(p) - avg(y), 5) + 0.0 as gap from pp group by grouping sets ((key), ())""", bars=True)
def production_brier(spark, sf_dir):
    """Brier score of the chance of each written target against whether its band was reached in time, by target and in all."""
    b = bars(spark, sf_dir)
    from .indicators import term_structure

    t = term_structure(b).select("symbol", "i", "close", "s20", "s60", "s120")
    x = evaluate(banded(target_log(b), b), b).where("state <> 'pending'").join(t, ["symbol", "i"])
    x = x.selectExpr("key", "case when side = 'sell' then 1 else -1 end as dir", "cast(expect as double) as h", "case expect when 20 then s20 when 60 then s60 else s120 end as sigma", "price / close as bar", "cast(coalesce(days <= expect, false) as int) as y").where("sigma > 0")
    p = f"case when (1 - bar) * dir >= 0 then 1e0 else {first_passage_sql('ln(bar)', '0e0', 'sigma', 'h')} end"
    x = x.withColumn("p", F.expr(p))
    return with_total(x, [["key"]], F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 5).alias("brier"), (F.round(F.avg("p") - F.avg("y"), 5) + F.lit(0.0)).alias("gap"))


@query("cross_weight_sweep", BREADTH + ", cw as (select w, z.symbol, r, (select avg(sign(o.r)) from z o where o.symbol <> z.symbol) as others from z, (select unnest([2, 3, 4]) as w)) select w::int as w, symbol, round((sign(r) + w * others) / (1 + w), 6) + 0.0 as blended from cw", bars=True)
def cross_weight_sweep(spark, sf_dir):
    """A symbol's own 20-bar direction blended with the mean direction of the others, at weights 2, 3 and 4."""
    z = bars(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close", 20).over(by()) - 1).groupBy("symbol").agg(F.max_by("r", "i").alias("r"))
    all_ = z.agg(F.sum(F.signum("r")).alias("s"), F.count("r").alias("m"))  # one row
    x = z.crossJoin(all_).withColumn("cross", (F.col("s") - F.signum("r")) / (F.col("m") - 1)).withColumn("w", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))))
    return x.select("w", "symbol", (F.round((F.signum("r") + F.col("w") * F.col("cross")) / (1 + F.col("w")), 6) + F.lit(0.0)).alias("blended"))


@query("paired_dates", f", pd as (select a.symbol, a.date, a.close / b.close - 1 as r from bars a join bars b on b.symbol = a.symbol and b.date = a.date - 20), pn as (select date, avg(r) as mean, count(*) as n from pd group by 1 having count(*) = 3) select date::varchar as date, round(mean, 6) + 0.0 as mean from pn", bars=True)
def paired_dates(spark, sf_dir):
    """Mean return over 20 calendar days on dates that all three symbols have on both ends: two equi-joins."""
    b = bars(spark, sf_dir).select("symbol", "date", "close")
    old = b.select("symbol", F.date_add("date", 20).alias("date"), F.col("close").alias("before"))
    x = b.join(old, ["symbol", "date"]).groupBy("date").agg(F.avg(F.col("close") / F.col("before") - 1).alias("mean"), F.count("*").alias("n")).where("n = 3")
    return x.select(F.col("date").cast("string").alias("date"), (F.round("mean", 6) + F.lit(0.0)).alias("mean"))


# --------------------------------------------------------------------------------------------------- combined signals
@query("sig_elliott", SWINGS + f""", x as (select *, case when type = 'L' then 1 else -1 end as u, {SIX} from sw window w as (partition by symbol order by pno)), imp as (select symbol, i as a, i5 as b, -u as signal from x where {IMPULSE}),
  el as (select symbol, b as i, signal, 1 as prio from imp union all select symbol, i3, -u, 2 from x where {ABC} and not exists (select 1 from imp where imp.symbol = x.symbol and x.i >= imp.a and x.i3 <= imp.b)) select symbol, i, arg_max(signal, prio) as signal from el group by 1, 2""", bars=True)
def sig_elliott(spark, sf_dir):
    """One signal of impulses and corrections; where both end on one bar, the correction's stands."""
    s = swings(bars(spark, sf_dir))
    imp = impulses(s)
    span = imp.select("symbol", F.col("i").alias("a"), F.col("i5").alias("b"))
    x = s.withColumns({f"{c[0]}{k}": F.lead(c, k).over(pw()) for k in range(1, 4) for c in ("price", "i")}).withColumn("u", F.when(F.col("type") == "L", 1).otherwise(-1)).where(ABC)
    x = x.join(span, (x["symbol"] == span["symbol"]) & (x["i"] >= span["a"]) & (x["i3"] <= span["b"]), "left_anti")
    both = imp.select("symbol", F.col("i5").alias("i"), (-F.col("u")).alias("signal"), F.lit(1).alias("prio")).union(x.select("symbol", F.col("i3"), -F.col("u"), F.lit(2)))
    return both.groupBy("symbol", "i").agg(F.max_by("signal", "prio").alias("signal"))


_SMC = SWINGS + f""", sm0 as (select b.symbol, b.i, b.high, b.low, b.close, lag(b.close) over (partition by b.symbol order by b.i) as before, last_value(case when s.type = 'H' then s.price end ignore nulls) over o as h, last_value(case when s.type = 'L' then s.price end ignore nulls) over o as l,
  lag(b.high, 2) over (partition by b.symbol order by b.i) as h2, lag(b.low, 2) over (partition by b.symbol order by b.i) as l2 from bars b left join sw s on s.symbol = b.symbol and s.i + 5 = b.i window o as (partition by b.symbol order by b.i)),
sm1 as (select *, case when close > h and before <= h then 1 when close < l and before >= l then -1 else 0 end as brk, case when low > h2 then 1 when high < l2 then -1 else 0 end as fvg from sm0),
sm2 as (select *, lag(brk) over (partition by symbol order by i) as lastbrk from sm1 where brk <> 0)"""


@query("sig_smart_money", _SMC + " select symbol, i, case when lastbrk is not null and lastbrk <> brk then 'change' else 'break' end as kind, case when brk * fvg >= 0 then brk else 0 end as signal from sm2", bars=True)
def sig_smart_money(spark, sf_dir):
    """Breaks of the last known swing: a change of character where the last break went the other way, else a break of structure;
    a signal only if the bar's fair-value gap does not point the other way."""
    b = bars(spark, sf_dir)
    s = swings(b).select("symbol", (F.col("i") + 5).alias("i"), F.when(F.col("type") == "H", F.col("price")).alias("sh"), F.when(F.col("type") == "L", F.col("price")).alias("sl"))
    w = by().rowsBetween(-(2**31) + 1, 0)
    x = b.join(s, ["symbol", "i"], "left").withColumns({"h": F.last("sh", True).over(w), "l": F.last("sl", True).over(w), "before": F.lag("close").over(by()), "h2": F.lag("high", 2).over(by()), "l2": F.lag("low", 2).over(by())})
    x = x.withColumns({"brk": F.expr("case when close > h and before <= h then 1 when close < l and before >= l then -1 else 0 end"), "fvg": F.expr("case when low > h2 then 1 when high < l2 then -1 else 0 end")}).where("brk <> 0")
    x = x.withColumn("lastbrk", F.lag("brk").over(by()))
    return x.select("symbol", "i", F.expr("case when lastbrk is not null and lastbrk <> brk then 'change' else 'break' end").alias("kind"), F.expr("case when brk * fvg >= 0 then brk else 0 end").alias("signal"))


SIG_STROKES_SQL = sql("select symbol, i1 as i, arg_min(signal, (kind, signal))::int as signal, min(kind) as kind from (select p.symbol, s.i1, p.kind, p.signal from pt p join dn s on s.symbol = p.symbol and s.no = p.no) group by 1, 2", ALL + POINTS)


@query("sig_strokes", SIG_STROKES_SQL)
def sig_strokes(spark, sf_dir):
    """One signal a bar of the structure: of several points on one bar, the kind with the smallest number stands."""
    p = dated_points(kept(bars(spark, sf_dir)))
    return p.groupBy("symbol", F.col("i1").alias("i")).agg(F.min_by("signal", F.struct("kind", "signal")).alias("signal"), F.min("kind").alias("kind"))


# ------------------------------------------------------------------------------------------------------- small columns
@query("three_zone_state", zsql(LABELS + " select symbol, case when close < k then 'risk' when close < w4 then 'base' else 'strong' end as state from wp"))
def three_zone_state(spark, sf_dir):
    """Below the line, below the end of wave 4, or above."""
    b = bars(spark, sf_dir)
    return wave_labels(b, zigzag(b)).selectExpr("symbol", "case when close < k then 'risk' when close < w4 then 'base' else 'strong' end as state")


@query("finite_or_default", "select event_id, case when value is null or isnan(value) or isinf(value) then 0 else value end as v, round(case when event_id % 7 = 0 then -1 else ln(event_id % 7) end, 6) as w from events")
def finite_or_default(spark, sf_dir):
    """Values that are no finite number take a default (here also the logarithm of 0)."""
    e = table(spark, sf_dir, "events")
    x = F.col("event_id") % 7
    return e.select("event_id", finite(F.col("value"), 0.0).alias("v"), F.round(finite(F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x.cast("double"))), -1.0), 6).alias("w"))


@query("labels_of_change", BREADTH + " select symbol, case when r >= 0 then '+' else '-' end || printf('%.2f', abs(r) * 100) || '%' as label, case when r > 0.02 then 'rising' when r < -0.02 then 'falling' else 'flat' end as state from z", bars=True)
def labels_of_change(spark, sf_dir):
    """Texts of a 20-bar change."""
    z = bars(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close", 20).over(by()) - 1).groupBy("symbol").agg(F.max_by("r", "i").alias("r"))
    return z.select("symbol", F.concat(F.when(F.col("r") >= 0, "+").otherwise("-"), F.format_string("%.2f", F.abs("r") * 100), F.lit("%")).alias("label"), F.expr("case when r > 0.02D then 'rising' when r < -0.02D then 'falling' else 'flat' end").alias("state"))


@query("sparkline_tail", ", sk as (select symbol, i, close, row_number() over (partition by symbol order by i desc) as k from bars), sp as (select * from sk where k <= 60) select symbol, count(*) as n, string_agg(round((close - lo) / nullif(hi - lo, 0) * 7)::bigint::varchar, '' order by i) as line from (select *, min(close) over (partition by symbol) as lo, max(close) over (partition by symbol) as hi from sp) group by 1", bars=True)
def sparkline_tail(spark, sf_dir):
    """The last 60 closes in eight steps, as one string."""
    x = bars(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i")))).where("k <= 60")
    w = Window.partitionBy("symbol")
    step = F.round((F.col("close") - F.min("close").over(w)) / F.nullif(F.max("close").over(w) - F.min("close").over(w), F.lit(0.0)) * 7).cast("long").cast("string")
    x = x.withColumn("step", step).groupBy("symbol").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i", "step"))).alias("l"))
    return x.select("symbol", "n", F.array_join(F.col("l.step"), "").alias("line"))


_RSI = f""", rm as (select symbol, i, close - lag(close) over ({P}) as x from bars), ru as (select symbol, i, case when x > 0 then x else x * 0 end as u, case when x < 0 then -x else x * 0 end as d from rm), {sql_ema('u', '(1.0/14)', 'ra', 'ru')}, {sql_ema('d', '(1.0/14)', 'rb', 'ru')},
rs as (select ra.symbol, ra.i, case when ra.i >= 14 and rb.v <> 0 then 100 - 100 / (1 + ra.v / rb.v) end as rsi from ra join rb using (symbol, i))"""


@query("sig_by_rsi_divergence", f"{_RSI}, dv0 as (select symbol, i, high, rsi, max(i) over (partition by symbol) as mi, max(high) over ({P} rows between 5 preceding and 5 following) as m, count(*) over ({P} rows between 5 preceding and 5 following) as n from bars join rs using (symbol, i)), pk as (select * from dv0 where n = 11 and high = m and i > mi - 90) select a.symbol, a.i as peak, arg_max(b.i, (b.high, -b.i)) as before, a.high > max(b.high) and a.rsi < arg_max(b.rsi, (b.high, -b.i)) as divergence from pk a join pk b on a.symbol = b.symbol and a.i - b.i between 8 and 60 group by a.symbol, a.i, a.high, a.rsi", bars=True)
def sig_by_rsi_divergence(spark, sf_dir):
    """Recent peaks against the best peak 8 to 60 bars before: a higher high at a lower RSI."""
    w = by().rowsBetween(-5, 5)
    x = rsi_columns(bars(spark, sf_dir)).withColumns({"m": F.max("high").over(w), "n": F.count("*").over(w), "mi": F.max("i").over(Window.partitionBy("symbol"))}).where("n = 11 and high = m and i > mi - 90")
    a, b = x.select("symbol", F.col("i").alias("peak"), F.col("high").alias("ah"), F.col("rsi").alias("ar")), x.select("symbol", "i", "high", "rsi")
    best = a.join(b, "symbol").where("peak - i between 8 and 60").groupBy("symbol", "peak").agg(F.max_by(F.struct("i", "high", "rsi"), F.struct("high", -F.col("i"))).alias("b"), F.first("ah").alias("ah"), F.first("ar").alias("ar"))
    return best.select("symbol", "peak", F.col("b.i").alias("before"), ((F.col("ah") > F.col("b.high")) & (F.col("ar") < F.col("b.rsi"))).alias("divergence"))
