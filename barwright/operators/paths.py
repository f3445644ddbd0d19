"""Three paths ahead of each symbol: their templates by scenario, and their chances as an ordered list of adjustments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.bars import bars
from ..sources.shared import kept
from .reports import outcomes
from .strokes import Structure, completed, composite, confidences, horizons, path_samples, points, scenario_sql, scenarios, sql, stability, structure, waning

# Percent of the horizon, what the price there is measured by, and the factor on it. A path begins at the close.
TEMPLATES = {
    "rising": {
        "main": [(25, "zg", 1.003), (55, "goal", 1.0), (100, "goal", 1.03)],
        "alt": [(30, "mid", 1.0), (60, "mid", 1.0), (100, "zg", 0.99)],
        "risk": [(25, "zd", 1.01), (55, "zd", 0.98), (100, "zd", 0.94)],
    },
    "firm": {
        "main": [(20, "zg", 1.004), (45, "mid", 1.0), (70, "zg", 1.0), (100, "zg", 1.03)],
        "alt": [(25, "mid", 1.0), (50, "zd", 1.01), (80, "mid", 1.0), (100, "mid", 1.0)],
        "risk": [(25, "zd", 1.0), (55, "zd", 0.98), (100, "zd", 0.94)],
    },
    "bottoming": {
        "main": [(20, "mid", 1.0), (50, "zg", 0.99), (100, "zg", 1.02)],
        "alt": [(30, "mid", 1.0), (100, "mid", 1.0)],
        "risk": [(25, "zd", 0.99), (100, "zd", 0.93)],
    },
    "weak": {
        "main": [(20, "zg", 1.0), (50, "mid", 1.0), (100, "mid", 0.99)],
        "alt": [(30, "zd", 1.01), (100, "zd", 0.98)],
        "risk": [(25, "zd", 0.99), (100, "zd", 0.92)],
    },
    "neutral": {
        "main": [(25, "mid", 1.0), (50, "mid", 1.0), (100, "mid", 1.0)],
        "alt": [(30, "zg", 0.99), (100, "zg", 0.97)],
        "risk": [(30, "zd", 1.01), (100, "zd", 0.99)],
    },
}
GROUP = """case when scenario = 'rising' then 'rising' when scenario in ('range, firm', 'pause below the high') then 'firm' when scenario = 'bottoming divergence' then 'bottoming'
  when scenario in ('topping divergence', 'range, weak', 'falling') then 'weak' else 'neutral' end"""
_POINTS = ", ".join(f"('{g}', '{p}', {f}, '{of}', {x}e0)" for g, paths in TEMPLATES.items() for p, at in paths.items() for f, of, x in [(0, "close", 1.0), *at])
_PRICE = "factor * case measure when 'close' then close when 'zg' then zg when 'zd' then zd when 'mid' then (zg + zd) / 2 else greatest(zg * 1.01e0, close * (1 + move)) end"
_FACTS = ["symbol", f"{GROUP} as grp", "close", "coalesce(zg, close * 1.05e0) as zg", "coalesce(zd, close * 0.95e0) as zd", "coalesce(move, 0.03e0) as move"]
_LERP = "floor((v0 + (v1 - v0) * (t - t0) / (t1 - t0)) * 1e4 + 0.5e0) / 1e4"  # four places, the same at ties in both engines


def moves(s: DataFrame) -> DataFrame:
    """symbol, move: the size of the last stroke that is complete, at least 3 percent."""
    k = s.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("no")))).where("k <= 2")
    return k.groupBy("symbol").agg(F.greatest(F.max_by(F.abs(F.col("p1") / F.col("p0") - 1), "k"), F.lit(0.03)).alias("move"))


def template_points(x: DataFrame) -> DataFrame:
    """symbol, path, t (percent of the horizon), v: the corners of the three paths; x has scenario, close, zg, zd and move. Without
    a zone its edges are 5 percent off the close. The table of corners is fixed (48 rows) and is broadcast."""
    corner = x.sparkSession.sql(f"select * from values {_POINTS} as c (grp, path, t, measure, factor)")
    return x.selectExpr(*_FACTS).join(F.broadcast(corner), "grp").selectExpr("symbol", "path", "t", f"{_PRICE} as v")


@query("path_templates", sql(f"select symbol, path, t::int as t, {_LERP} as price from pg", scenario_sql() + f""", mv as (select symbol, greatest(arg_min(abs(p1 / p0 - 1), no), 0.03e0) as move from (select * from sk qualify row_number() over (partition by symbol order by no desc) <= 2) group by 1),
pf as (select {', '.join(_FACTS)} from sc left join mv using (symbol)), pc as (select symbol, path, t, {_PRICE} as v from pf join (values {_POINTS}) c (grp, path, t, measure, factor) using (grp)),
ps as (select symbol, path, t as t0, v as v0, lead(t) over w as t1, lead(v) over w as v1 from pc window w as (partition by symbol, path order by t)),
pg as (select symbol, path, k as t, t0, t1, v0, v1 from ps, (select unnest(generate_series(0, 100, 5)) as k) where k >= t0 and (k < t1 or (k = 100 and t1 = 100)))"""))
def path_templates(spark, sf_dir):
    """The price of each path at every twentieth of the horizon, straight between the corners of its template."""
    of = structure(bars(spark, sf_dir))
    w = Window.partitionBy("symbol", "path").orderBy("t")
    c = template_points(scenarios(of.bars, of=of).join(moves(of.strokes), "symbol", "left"))
    s = c.select("symbol", "path", F.col("t").alias("t0"), F.col("v").alias("v0"), F.lead("t").over(w).alias("t1"), F.lead("v").over(w).alias("v1")).where("t1 is not null")
    return s.withColumn("t", F.explode(F.expr("sequence(t0, case when t1 = 100 then 100 else t1 - 5 end, 5)"))).selectExpr("symbol", "path", "t", f"{_LERP} as price")


# ------------------------------------------------------------------------------------------------------------ chances
# Chance of the main path by scenario; any other has 0.45.
BASE = {"rising": 0.58, "range, firm": 0.50, "pause below the high": 0.50, "topping divergence": 0.40, "range, weak": 0.40, "falling": 0.34}
_BASE = "case scenario " + " ".join(f"when '{s}' then {p}e0" for s, p in BASE.items()) + " else 0.45e0 end"
#: How much the history of the main path counts (from 8 weighted samples on), or else the points of the scenario's side (from 5).
TRUST = "case when side <> 0 and past_n >= 8 then least(0.85e0, past_n / (past_n + 12) * 1.6e0) else 0e0 end"
TRUST_POINT = "case when point_n >= 5 then point_n / (point_n + 12e0) else 0e0 end"

#: The steps in order: name, and the new chance p of the main path by the one before it and the facts. `side` is 1 where the
#: scenario rises, -1 where it falls, 0 where it does neither.
STEPS = [
    ("history", "case when trust > 0 then p * (1 - trust) + past_main * trust when trust_point > 0 then p * (1 - trust_point) + (0.5e0 + (point_win - 0.5e0) * 0.7e0) * trust_point else p end"),
    ("confidence", "p + (confidence - 50) / 100e0 * 0.3e0"),
    ("stability", "p - case level when 'to be confirmed' then 0.04e0 when 'borderline' then 0.02e0 else 0e0 end"),
    ("fit", "p + case when fits and not slowing then 0.02e0 else 0e0 end"),
    ("nesting", "p + case when nesting <> 'none' then 0.03e0 else 0e0 end"),
    ("month", "p + side * month_polarity * 0.02e0"),
    ("turn", "p + side * case when trend_turns > 0 then 0.03e0 when turns > 0 and range_turns = turns then -0.02e0 else 0e0 end"),
    ("strength", "p + side * case when least_ratio <= 0.65e0 then 0.01e0 when least_ratio >= 0.92e0 then -0.01e0 else 0e0 end"),
    ("volume", "p + side * case when mid_volume < 0.85e0 then 0.01e0 when mid_volume > 1.15e0 then -0.01e0 else 0e0 end"),
    ("distance", "p + side * case when bias > 0.06e0 then -0.03e0 when bias < -0.06e0 then 0.03e0 else 0e0 end"),
    ("past", "case when trust > 0 then greatest(greatest(0.3e0, past_main * 0.55e0), least(p, least(0.72e0, 0.42e0 + past_main * 0.42e0))) else p end"),
    ("breadth", "least(p, case when (side = 1 and score <= -0.2e0) or (side = -1 and score >= 0.2e0) then 0.5e0 else 1e0 end)"),
    ("bounds", "greatest(0.3e0, least(0.72e0, round(p, 2)))"),
]


def chances(facts: DataFrame) -> DataFrame:
    """Adds p_base, p_<step> for each of STEPS, and main, alt, risk, which sum to 1. What the main path leaves is shared by the
    history of the other two, as far as it is trusted, else 55 to 45; the risk path has at least 0.05.

    Facts (one row a symbol; those that are null change nothing): scenario, side, past_n, past_main, past_alt, past_risk, point_n,
    point_win, confidence, level, fits, slowing, nesting, month_polarity, trend_turns, range_turns, turns, least_ratio, mid_volume,
    bias, score."""
    neutral = {"confidence": F.lit(50), "fits": F.lit(False), "slowing": F.lit(False), "nesting": F.lit("none"), "month_polarity": F.lit(0), "side": F.lit(0)}
    x = facts.withColumns({c: F.coalesce(F.col(c), v) for c, v in neutral.items()})
    x = x.withColumns({"trust": F.expr(TRUST), "trust_point": F.expr(TRUST_POINT), "p_base": F.expr(_BASE)})
    before = "p_base"
    for name, step in STEPS:
        x = x.withColumn("p", F.col(before)).withColumn(f"p_{name}", F.expr(step)).drop("p")
        before = f"p_{name}"
    x = x.withColumns({"main": F.col(before), "rest": F.round(1 - F.col(before), 2)})
    x = x.withColumn("share", F.expr("case when trust > 0 and past_alt + past_risk > 0 then round(0.55e0 * (1 - trust) + past_alt / (past_alt + past_risk) * trust, 3) else 0.55e0 end"))
    x = x.withColumn("risk", F.expr("greatest(0.05e0, round(rest - round(rest * share, 2), 2))"))
    return x.withColumn("alt", F.expr("round(rest - risk, 2)")).drop("rest", "share")


def fits(b: DataFrame, h: DataFrame) -> DataFrame:
    """symbol, r2, ahead, one_way, slowing: the log-linear fit of the last `horizon` closes (at most 90) and its factor at the
    horizon; whether the slopes of the last 20, 60 and 120 closes (two or more of these) have one sign; whether a rise that
    they agree on is slower in the second half. One aggregate a symbol."""
    x = b.join(h, "symbol").withColumns({"k": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i"))), "n": F.count("*").over(Window.partitionBy("symbol"))})
    x = x.withColumns({"y": F.ln("close"), "m": F.least(F.col("horizon"), F.lit(90), F.col("n"))}).withColumn("half", F.col("m") - F.floor(F.col("m") / 2))
    part = lambda c: F.when(c, F.col("y"))
    slope = lambda c: F.when(F.count(part(c)) >= 10, F.coalesce(F.regr_slope(part(c), F.col("i")), F.lit(0.0)))
    own = F.col("k") <= F.col("m")
    windows = [F.when(F.max("n") >= w, slope(F.col("k") <= w)).alias(f"s{w}") for w in (20, 60, 120)]
    f = x.groupBy("symbol").agg(slope(own).alias("s"), F.regr_r2(part(own), F.col("i")).alias("r2"), slope(own & (F.col("k") > F.col("half"))).alias("early"), slope(F.col("k") <= F.col("half")).alias("late"), F.max("horizon").alias("horizon"), F.max("m").alias("m"), *windows)
    f = f.withColumn("one_way", F.expr("s20 is not null and s60 is not null and ((s20 > 0 and s60 > 0 and coalesce(s120, 1) > 0) or (s20 < 0 and s60 < 0 and coalesce(s120, -1) < 0))"))
    slowing = "one_way and s > 0 and m >= 12 and coalesce(late, 0) - coalesce(early, 0) < -1e-5 and r2 > 0.3e0"
    return f.selectExpr("symbol", "r2", "exp(s * horizon) as ahead", "one_way", f"coalesce({slowing}, false) as slowing")


def path_facts(b: DataFrame) -> DataFrame:
    """One row a symbol with all that chances() reads. Bars, strokes, zones and divergences are kept once."""
    of = structure(b)
    s = kept(of.strokes)
    of = Structure(of.bars, s, kept(of.zones), of.legs, kept(of.divergences))
    b, x = of.bars, kept(confidences(of).withColumn("side", F.col("polarity")).drop("level", "slope", "bars"))
    symbol = Window.partitionBy("symbol")
    past = path_samples(b).groupBy("symbol", F.col("main_dir").alias("side")).agg(F.sum("weight").alias("past_n"), *[(F.sum(F.when(F.col("hit") == h, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias(f"past_{h}") for h in ("main", "alt", "risk")])
    # the latest point of the last 60 strokes, of the scenario's side, whose kind has five outcomes or more after 20 bars
    own = outcomes(b, of).where("h = 20").groupBy("symbol", "kind", "signal").agg(F.count("*").alias("point_n"), F.avg("win").alias("point_win")).where("point_n >= 5")
    latest = points(s, of.zones, of.divergences).join(x.select("symbol", "strokes", F.col("side").alias("signal")), ["symbol", "signal"]).where("no >= strokes - 60").join(own, ["symbol", "kind", "signal"])
    point = latest.groupBy("symbol").agg(F.max_by(F.struct("point_n", "point_win"), F.struct(F.col("no"), -F.col("kind"))).alias("x")).select("symbol", "x.*")
    d = of.divergences.join(x.select("symbol", "strokes"), "symbol")
    recent = F.col("no") >= F.col("strokes") - 3
    turns = d.groupBy("symbol").agg(F.count_if(recent).alias("turns"), F.count_if(recent & (F.col("class") == "trend")).alias("trend_turns"), F.count_if(recent & (F.col("class") == "range")).alias("range_turns"), F.min(F.when((F.col("no") >= F.col("strokes") - 5) & (F.col("area_ratio") > 0), F.col("area_ratio"))).alias("r1"))
    legs = waning(of.legs, ("high", "low")).withColumn("k", F.row_number().over(symbol.orderBy(F.desc("no")))).where("k <= 3 and area_ratio > 0").groupBy("symbol").agg(F.min("area_ratio").alias("r2_"))
    v = of.divergences.where("vol_ratio is not null").withColumns({"k": F.row_number().over(symbol.orderBy("vol_ratio")), "c": F.count("*").over(symbol)})
    volume = v.where("k = floor(c / 2) + 1").select("symbol", F.col("vol_ratio").alias("mid_volume"))
    far = b.withColumn("bias", F.col("close") / F.avg("close").over(Window.partitionBy("symbol").orderBy("i").rowsBetween(-19, 0)) - 1).groupBy("symbol").agg(F.max_by("bias", "i").alias("bias"))
    x = x.join(moves(s), "symbol", "left").join(past, ["symbol", "side"], "left")
    ends = template_points(x).where("path = 'main' and t in (0, 100)").groupBy("symbol").agg(F.avg("v").alias("middle"))
    for f in (point, turns, legs, volume, far, stability(b).select("symbol", "level"), fits(b, horizons(s)), ends):
        x = x.join(f, "symbol", "left")
    x = x.withColumns({"least_ratio": F.least("r1", "r2_"), "fits": F.expr("abs(close * ahead - middle) / middle < 0.06e0 and r2 >= 0.25e0 and one_way")})
    return x.crossJoin(F.broadcast(composite(x).select("score")))  # one row


@query("path_chances")
def path_chances(spark, sf_dir):
    """Three rows a symbol: the chances of its paths. It reads the history of cut series (path_hit_rates), which has no SQL; tests hold
    every step against values worked out by hand."""
    x = chances(path_facts(bars(spark, sf_dir)))
    return x.select("symbol", "scenario", F.explode(F.create_map(*[c for p in ("main", "alt", "risk") for c in (F.lit(p), F.col(p))])).alias("path", "chance"))


@query("path_steps")
def path_steps(spark, sf_dir):
    """How the chance of the main path came about: one row a step, with the chance after it."""
    x = chances(path_facts(bars(spark, sf_dir)))
    names = ["base", *[name for name, _ in STEPS]]
    return x.select("symbol", F.posexplode(F.array(*[F.struct(F.lit(n).alias("step"), F.round(f"p_{n}", 6).alias("chance")) for n in names])).alias("no", "x")).select("symbol", "no", "x.*")
