"""The wave plan: targets, supports, trade plan, rule card, ratios, channel, scenario paths and sub-waves of labelled waves.

Labels (the start of wave 1, its end, and the ends of waves 2, 3 and 4) are an input; the queries take the last five confirmed
pivots that end in a low. One row per symbol carries everything, so all that follows is projections of that row and,
where history is asked, joins with the small table of legs. Formulas are written once, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import with_total
from ..plans.registry import query
from ..sources.bars import bars
from ..sources.shared import kept
from .waves import LEGS, RATIO_SQL, RUN_LEG, RUNS, five_wave_runs, legs, pw, run_ratios, time_to_reach, zigzag, zsql

POINTS = ("s", "k", "w2", "w3", "w4")


def wave_labels(b: DataFrame, z: DataFrame) -> DataFrame:
    """Per symbol: prices s (start), k (end of wave 1, the line that must hold), w2, w3, w4, their bars i0 to i4 and dates d0 to
    d4, the last close, bar and date, the high and low of all bars."""
    back = {name: (c, 4 - n) for n in range(5) for name, c in ((POINTS[n], "price"), (f"i{n}", "i"), (f"d{n}", "date"))}
    x = z.where("not unconfirmed").withColumns({f"{name}_": F.lag(c, n).over(pw()) for name, (c, n) in back.items()})
    x = x.where("type = 'L' and s_ is not null").withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("pno")))).where("r = 1")
    ends = b.groupBy("symbol").agg(F.max_by("close", "i").alias("close"), F.max("i").alias("n"), F.max("date").alias("last"), F.max("high").alias("hi5"), F.min("low").alias("lo5"), (F.datediff(F.max("date"), F.min("date")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("pace"))
    return x.select("symbol", *[F.col(f"{name}_").alias(name) for name in back]).join(ends, "symbol")


LABELS = ", wl as (select symbol, " + ", ".join(f"lag({c}, {4 - n}) over w as {name}" for n in range(5) for name, c in ((POINTS[n], "price"), (f"i{n}", "i"), (f"d{n}", "date"))) + """, type, pno from piv where not unconfirmed window w as (partition by symbol order by pno)),
wn as (select symbol, arg_max(close, i) as close, max(i) as n, max(date) as last, max(high) as hi5, min(low) as lo5, datediff('day', min(date), max(date)) / greatest(count(*) - 1, 1)::double as pace from bars group by 1),
wp as (select * exclude (type, pno) from (select * from wl where type = 'L' and s is not null qualify row_number() over (partition by symbol order by pno desc) = 1) join wn using (symbol))"""

W1, W3, ALL5 = "greatest(k - s, 1e-9)", "(w3 - w2)", "(hi5 - lo5)"
TARGETS = {"wave 5 = 0.618 wave 3": f"w4 + {W3} * 0.618e0", "wave 5 = 1.618 wave 1": f"w4 + {W1} * 1.618e0", "range x 1.272": f"lo5 + {ALL5} * 1.272e0", "wave 5 = wave 1": f"w4 + {W1}", "range x 1.618": f"lo5 + {ALL5} * 1.618e0"}
SUPPORTS = {"wave 3 less 38.2%": f"w3 - {W3} * 0.382e0", "end of wave 1": "k", "wave 3 less 50%": f"w3 - {W3} * 0.5e0", "wave 3 less 61.8%": f"w3 - {W3} * 0.618e0", "range less 50%": f"hi5 - {ALL5} * 0.5e0", "range less 61.8%": f"hi5 - {ALL5} * 0.618e0"}
SELLS = {"sell 1": TARGETS["wave 5 = 0.618 wave 3"], "sell 2": TARGETS["wave 5 = wave 1"], "sell 3": TARGETS["wave 5 = 1.618 wave 1"]}


def spark_rows(x: DataFrame, rows: list[dict[str, str]], keep: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row per dict of column -> SQL expression, for each row of x."""
    one = F.explode(F.array(*[F.struct(*[F.expr(v).alias(c) for c, v in row.items()]) for row in rows])).alias("o")
    return x.select(*keep, one).select(*keep, "o.*")


def sql_rows(source: str, rows: list[dict[str, str]], keep: tuple[str, ...] = ("symbol",)) -> str:
    return " union all ".join(f"select {', '.join(keep)}, {', '.join(f'{v} as {c}' for c, v in row.items())} from {source}" for row in rows)


def rounded(x: str, places: int = 4) -> str:
    return f"round({x}, {places}) + 0e0"


def labelled(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir)
    return wave_labels(b, zigzag(b))


_T = [{"name": f"'{n}'", "price": rounded(e), "pct": rounded(f"(({e}) / close - 1) * 100")} for n, e in TARGETS.items()]
_S = [{"name": f"'{n}'", "price": rounded(e), "is_line": "true" if n == "end of wave 1" else "false"} for n, e in SUPPORTS.items()]


@query("plan_targets", zsql(LABELS + " " + sql_rows("wp", _T)))
def plan_targets(spark, sf_dir):
    """Ends of wave 5 by its ratios to waves 1 and 3, extensions of the whole range, and how far they are."""
    return spark_rows(labelled(spark, sf_dir), _T)


@query("plan_supports", zsql(LABELS + " " + sql_rows("wp", _S)))
def plan_supports(spark, sf_dir):
    return spark_rows(labelled(spark, sf_dir), _S)


_P = [
    {"kind": "'buy zone'", "name": "'core'", "hi": rounded(SUPPORTS["wave 3 less 38.2%"]), "lo": rounded("k")}, *[{"kind": "'sell'", "name": f"'{n}'", "hi": rounded(e), "lo": rounded(e)} for n, e in SELLS.items()],
    {"kind": "'stop'", "name": "'end of wave 1'", "hi": rounded("k"), "lo": rounded("k")}, {"kind": "'trail'", "name": "'half below the mean of 20'", "hi": rounded("ma20"), "lo": rounded("ma20")}, {"kind": "'trail'", "name": "'half again below the mean of 60'", "hi": rounded("ma60"), "lo": rounded("ma60")},
]


@query("trade_plan", zsql(LABELS + ", tm as (select symbol, avg(close) filter (k <= 20) as ma20, case when count(*) >= 60 then avg(close) filter (k <= 60) end as ma60 from (select symbol, close, row_number() over (partition by symbol order by i desc) as k from bars) group by 1), tp as (select * from wp join tm using (symbol)) " + sql_rows("tp", _P)))
def trade_plan(spark, sf_dir):
    """Buy zone, three sell targets, the line to stop at, and the trailing stops."""
    b = bars(spark, sf_dir)
    m = b.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i")))).groupBy("symbol").agg(F.avg(F.when(F.col("r") <= 20, F.col("close"))).alias("ma20"), F.when(F.count("*") >= 60, F.avg(F.when(F.col("r") <= 60, F.col("close")))).alias("ma60"))
    return spark_rows(wave_labels(b, zigzag(b)).join(m, "symbol"), _P)


_R = [
    {"rule": "'wave 2 holds the start'", "ok": "case when w2 > s then 'yes' else 'no' end", "value": rounded("w2 - s")}, {"rule": "'wave 3 is not the shortest'", "ok": f"case when {W3} > k - s then 'yes' else 'no' end", "value": rounded(f"{W3} - (k - s)")},
    {"rule": "'wave 4 stays out of wave 1'", "ok": "case when w4 > k then 'yes' else 'no' end", "value": rounded("w4 - k")}, {"rule": "'waves 2 and 4 alternate in time'", "ok": "case when abs((i2 - i1) - (i4 - i3)) * 2 >= least(i2 - i1, i4 - i3) then 'yes' else 'no' end", "value": rounded("(i2 - i1) - (i4 - i3) + 0e0")},
    {"rule": "'wave 5 keeps to the channel'", "ok": "'open'", "value": "cast(null as double)"},
]


@query("rule_card", zsql(LABELS + " " + sql_rows("wp", _R)))
def rule_card(spark, sf_dir):
    """The rules, as predicates over the labels. Alternation: the two lengths differ by half of the shorter one or more; what
    wave 5 does is not known yet."""
    return spark_rows(labelled(spark, sf_dir), _R)


_Q = [
    {"item": "'wave 2 of wave 1, percent'", "actual": rounded(f"(k - w2) / {W1} * 100"), "ok": f"(k - w2) / {W1} between 0.5e0 and 0.618e0"}, {"item": "'wave 3 to wave 1'", "actual": rounded(f"{W3} / {W1}"), "ok": f"{W3} / {W1} >= 1.5e0"},
    {"item": "'wave 4 of wave 3, percent'", "actual": rounded(f"(w3 - w4) / {W3} * 100"), "ok": f"(w3 - w4) / {W3} between 0.236e0 and 0.382e0"},
]


@query("ratio_check", zsql(LABELS + " " + sql_rows("wp", _Q)))
def ratio_check(spark, sf_dir):
    return spark_rows(labelled(spark, sf_dir), _Q)


_C = [{"side": "'lower'", "slope": rounded("(w4 - w2) / greatest(datediff_, 1)", 6), "at_end": rounded("w2 + (w4 - w2) / greatest(datediff_, 1) * span")}, {"side": "'upper'", "slope": rounded("(w4 - w2) / greatest(datediff_, 1)", 6), "at_end": rounded("w3 + (w4 - w2) / greatest(datediff_, 1) * (span - lead_)")}]


@query("plan_channel", zsql(LABELS + ", wc as (select *, datediff('day', d2, d4) as datediff_, datediff('day', d2, d3) as lead_, datediff('day', d2, d4 + 365) as span from wp) " + sql_rows("wc", _C)))
def plan_channel(spark, sf_dir):
    """The line through the ends of waves 2 and 4 and its parallel through the end of wave 3, a year after wave 4."""
    x = labelled(spark, sf_dir).withColumns({"datediff_": F.datediff("d4", "d2"), "lead_": F.datediff("d3", "d2"), "span": F.datediff(F.date_add("d4", 365), "d2")})
    return spark_rows(x, _C)


# ---------------------------------------------------------------------------------------------------- scenario paths
#: Anchors (days from the last bar, price) of three paths: base, strong, risk.
PATHS = {
    "base": [(0, "close"), (60, SUPPORTS["wave 3 less 38.2%"]), (150, "(w4 + w3) / 2"), (270, SELLS["sell 1"]), (360, SELLS["sell 2"])],
    "strong": [(0, "close"), (60, "w3"), (180, SELLS["sell 1"]), (270, SELLS["sell 3"])],
    "risk": [(0, "close"), (60, "k"), (120, SUPPORTS["wave 3 less 61.8%"]), (180, SUPPORTS["range less 50%"]), (270, SUPPORTS["range less 61.8%"])],
}
_A = [{"path": f"'{p}'", "t": str(t), "v": f"({e})"} for p, points in PATHS.items() for t, e in points]
_AT = "round(v + (v1 - v) * (t - t0) / (t1 - t0), 4)"


def along(anchors: DataFrame, keys: list[str], step: int) -> DataFrame:
    """keys, t, price: anchors (t, v) joined by straight lines, every `step` days from the first to the last."""
    w = Window.partitionBy(*keys).orderBy("t")
    x = anchors.withColumns({"t1": F.lead("t").over(w), "v1": F.lead("v").over(w)}).where("t1 is not null")
    x = x.withColumn("last_", F.max("t1").over(Window.partitionBy(*keys))).withColumnRenamed("t", "t0")
    end = F.when(F.col("t1") == F.col("last_"), F.col("t1")).otherwise(F.col("t1") - 1)
    return x.withColumn("t", F.explode(F.filter(F.sequence("t0", end), lambda k: k % step == 0))).select(*keys, "t", F.expr(_AT).alias("price"))


@query("scenario_paths", zsql(LABELS + ", an as (" + sql_rows("wp", _A) + f"), sg as (select symbol, path, t as t0, v, lead(t) over w as t1, lead(v) over w as v1, max(t) over (partition by symbol, path) as last_ from an window w as (partition by symbol, path order by t)), tt as (select (unnest(generate_series(0, 360, 30)))::int as t) select symbol, path, t, {_AT} as price from sg join tt on t >= t0 and (t < t1 or (t = t1 and t1 = last_)) where t1 is not null"))
def scenario_paths(spark, sf_dir):
    a = spark_rows(labelled(spark, sf_dir), _A)
    return along(a, ["symbol", "path"], 30)


# -------------------------------------------------------------------------------------------------------- sub-waves
STANDARD = (0.5, 1.618, 0.2917)  # Fixed values: ratios of the standard model


def model_errors(runs: DataFrame, q2: str, q3: str, q4: str) -> DataFrame:
    """Of a ratio model over all five-wave runs, per symbol and over all: median error of its turning prices (as a share of the
    net move), the 68th percentile of the error in percent, the median share of time gone by at each turn."""
    amp = f"(2 - {q2} + {q3} - {q4} * {q3})"
    pred = ["v0 + net / {a}", "v0 + (1 - {2}) * net / {a}", "v0 + (1 - {2} + {3}) * net / {a}", "v0 + (1 - {2} + {3} - {4} * {3}) * net / {a}", "v5"]
    pred = [p.replace("{a}", amp).replace("{2}", q2).replace("{3}", q3).replace("{4}", q4) for p in pred]
    x = runs.withColumn("net", F.col("v5") - F.col("v0")).withColumn("e", F.explode(F.array(*[F.struct((F.abs(F.expr(p) - F.col(f"v{k}")) / F.col("net")).alias("f"), (F.abs(F.expr(p) - F.col(f"v{k}")) / F.col(f"v{k}") * 100).alias("pct")) for k, p in enumerate(pred, 1)])))
    return with_total(x, [["symbol"]], F.round(F.median("e.f"), 4).alias("mae"), F.round(F.percentile("e.pct", 0.68), 2).alias("disp"))


def _errors_sql(out: str, source: str, q2: str, q3: str, q4: str) -> str:
    amp = f"(2 - {q2} + {q3} - {q4} * {q3})"
    pred = ["v0 + net / {a}", "v0 + (1 - {2}) * net / {a}", "v0 + (1 - {2} + {3}) * net / {a}", "v0 + (1 - {2} + {3} - {4} * {3}) * net / {a}", "v5"]
    pred = [p.replace("{a}", amp).replace("{2}", q2).replace("{3}", q3).replace("{4}", q4) for p in pred]
    rows = " union all ".join(f"select symbol, abs({p} - v{k}) / net as f, abs({p} - v{k}) / v{k} * 100 as pct from {out}n" for k, p in enumerate(pred, 1))
    return f", {out}n as (select *, v5 - v0 as net from {source}), {out} as (select symbol, round(median(f), 4) as mae, round(quantile_cont(pct, 0.68), 2) as disp from ({rows}) group by grouping sets ((symbol), ()))"


_STD = tuple(f"{x}e0" for x in STANDARD)
_CUM = ", ".join(f"round(median(greatest(0, least(1, datediff_{k} / greatest(1, datediff_5)))), 3) as t{k}" for k in range(1, 5))


@query("subwave_errors", zsql(RUNS + _errors_sql("se", "runs", *_STD) + f", sd as (select symbol, {', '.join(f'datediff({chr(39)}day{chr(39)}, t0, t{k})::double as datediff_{k}' for k in range(1, 6))} from runs), sc as (select symbol, count(*) as n, {_CUM} from sd group by grouping sets ((symbol), ())) select sc.*, mae, disp from sc join se on sc.symbol is not distinct from se.symbol"))
def subwave_errors(spark, sf_dir):
    """Errors of the standard model, and the median share of time gone by at each turn."""
    r = five_wave_runs(legs(zigzag(bars(spark, sf_dir)), RUN_LEG))
    share = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff(f"t{k}", "t0") / F.greatest(F.lit(1), F.datediff("t5", "t0"))))
    t = with_total(r, [["symbol"]], F.count("*").alias("n"), *[F.round(F.median(share(k)), 3).alias(f"t{k}") for k in range(1, 5)])
    e = model_errors(r, *_STD).withColumnRenamed("symbol", "s_")
    return t.join(e, F.col("symbol").eqNullSafe(F.col("s_"))).drop("s_")


#: The model in use: measured ratios where there are enough sane runs; retracements scaled by today's volatility, wave 3 shortened
#: where waves 5 were often cut short. m: volatility today over its median, from 0.7 to 1.3; cut: share of runs cut short.
_M2, _M4 = f"greatest(0.236e0, least(0.618e0, coalesce(q2, {_STD[0]}) * m))", f"greatest(0.236e0, least(0.618e0, coalesce(q4, {_STD[2]}) * m))"
_M3 = f"(coalesce(q3, {_STD[1]}) * (1 - 0.15e0 * cut))"
_SUB = [{"wave": str(k), "price": rounded(p.replace("{a}", "(2 - r2 + r3 - r4 * r3)"))} for k, p in enumerate(["w4 + a / {a}", "w4 + a * (1 - r2) / {a}", "w4 + a * (1 - r2 + r3) / {a}", "w4 + a * (1 - r2 + r3 - r4 * r3) / {a}", "w4 + a"], 1)]


def volatility_ratio(b: DataFrame) -> DataFrame:
    from .indicators import hv20

    h = hv20(b).groupBy("symbol").agg(F.max_by("hv", "i").alias("now"), F.median("hv").alias("mid"))
    return h.select("symbol", F.coalesce(F.greatest(F.lit(0.7), F.least(F.lit(1.3), F.col("now") / F.when(F.col("mid") > 0, F.col("mid")))), F.lit(1.0)).alias("m"))


def model_in_use(b: DataFrame, z: DataFrame) -> DataFrame:
    """symbol, q2, q3, q4 (null: the standard model), m, cut. Measured ratios are used only where their error is smaller."""
    r = kept(five_wave_runs(legs(z, RUN_LEG)))
    q = run_ratios(r).where("symbol is not null and q2 is not null").select("symbol", "q2", "q3", "q4")
    own = model_errors(r.join(q, "symbol"), "q2", "q3", "q4").where("symbol is not null").select("symbol", F.col("mae").alias("own_mae"))
    base = model_errors(r, *_STD).where("symbol is not null").select("symbol", F.col("mae").alias("base_mae"))
    cut = r.groupBy("symbol").agg(F.avg(F.expr("case when v5 - v4 < v3 - v2 then 1.0D else 0.0D end")).alias("cut"))
    x = b.select("symbol").distinct().join(q.join(own, "symbol").join(base, "symbol"), "symbol", "left").join(cut, "symbol", "left").join(volatility_ratio(b), "symbol", "left")
    better, valid = F.col("own_mae") < F.col("base_mae"), F.col("q2").isNotNull()
    return x.select("symbol", *[F.when(better, F.col(c)).alias(c) for c in ("q2", "q3", "q4")], F.coalesce("m", F.lit(1.0)).alias("m"), F.when(valid, F.coalesce("cut", F.lit(0.0))).otherwise(0.0).alias("cut"))


def subwave_prices(x: DataFrame) -> DataFrame:
    """symbol, wave, price of labels joined with the model; the last one is the first sell target."""
    x = x.withColumns({"r2": F.expr(_M2), "r3": F.expr(_M3), "r4": F.expr(_M4), "a": F.expr(f"({SELLS['sell 1']}) - w4")})
    return spark_rows(x, _SUB)


def _model_sql() -> str:
    from .indicators import HV

    return RUNS + RATIO_SQL + _errors_sql("eb", "runs", *_STD) + ", rs as (select runs.*, q2, q3, q4 from runs join rr on rr.symbol = runs.symbol where q2 is not null)" + _errors_sql("eo", "rs", "q2", "q3", "q4") + HV.replace(", rt as", ", rt9 as").replace("from rt)", "from rt9)") + """, vr as (select symbol, coalesce(greatest(0.7, least(1.3, now / case when mid > 0 then mid end)), 1.0) as m from (select symbol, arg_max(hv, i) as now, median(hv) as mid from hv group by 1)),
cu as (select symbol, avg(case when v5 - v4 < v3 - v2 then 1.0 else 0.0 end) as cut from runs group by 1),
mo as (select s.symbol, case when eo.mae < eb.mae then q2 end as q2, case when eo.mae < eb.mae then q3 end as q3, case when eo.mae < eb.mae then q4 end as q4, coalesce(m, 1.0) as m, case when q2 is not null then coalesce(cut, 0.0) else 0.0 end as cut
  from (select distinct symbol from bars) s left join rr on rr.symbol = s.symbol left join eb on eb.symbol = s.symbol left join eo on eo.symbol = s.symbol left join vr on vr.symbol = s.symbol left join cu on cu.symbol = s.symbol)"""


_SUBSQL = f", sm as (select *, {_M2} as r2, {_M3} as r3, {_M4} as r4, ({SELLS['sell 1']}) - w4 as a from wp join mo using (symbol)), sp5 as (" + sql_rows("sm", _SUB) + ")"


@query("subwave_forecast", zsql(_model_sql() + LABELS + _SUBSQL + " select * from sp5"))
def subwave_forecast(spark, sf_dir):
    """Turning prices of the five parts of wave 5, locked to end at the first sell target."""
    b = bars(spark, sf_dir)
    z = zigzag(b)
    return subwave_prices(wave_labels(b, z).join(model_in_use(b, z), "symbol"))


@query("truncation", zsql(RUNS + ", tr as (select symbol, count(*) as n, round(avg(case when v5 - v4 < v3 - v2 then 1.0 else 0.0 end), 6) as cut, round(median((v5 - v4) / (v1 - v0)), 6) as r5 from runs group by 1)" + LABELS + f" select tr.symbol, tr.n, cut, r5, round(w4 + r5 * (({SELLS['sell 1']}) - w4), 4) as independent, round((({SELLS['sell 1']}) - (w4 + r5 * (({SELLS['sell 1']}) - w4))) / ({SELLS['sell 1']}) * 100, 4) + 0.0 as deviation from tr join wp using (symbol)"))
def truncation(spark, sf_dir):
    """Share of runs whose wave 5 is shorter than wave 3, the median of wave 5 to wave 1, and the end of wave 5 by that."""
    b = bars(spark, sf_dir)
    z = zigzag(b)
    t = five_wave_runs(legs(z, RUN_LEG)).groupBy("symbol").agg(F.count("*").alias("runs"), F.round(F.avg(F.expr("case when v5 - v4 < v3 - v2 then 1.0D else 0.0D end")), 6).alias("cut"), F.round(F.median(F.expr("(v5 - v4) / (v1 - v0)")), 6).alias("r5"))
    x = t.join(wave_labels(b, z), "symbol").withColumn("e", F.expr(SELLS["sell 1"]))
    return x.select("symbol", F.col("runs").alias("n"), "cut", "r5", F.round(F.expr("w4 + r5 * (e - w4)"), 4).alias("independent"), (F.round(F.expr("(e - (w4 + r5 * (e - w4))) / e * 100"), 4) + 0.0).alias("deviation"))


PRIOR_TIME = (0.18, 0.14, 0.36, 0.14, 0.18)  # Fixed values: shares of time of the five waves


def leg_times(l: DataFrame) -> DataFrame:
    """symbol, f1 to f5: mean shares of time of five legs in a row with signs + - + - +, blended half and half with the prior;
    0.20, 0.15, 0.30, 0.15, 0.20 where there is none."""
    x = l.withColumns({f"r{k}": F.lead("ret", k).over(pw()) for k in range(1, 5)} | {f"n{k}": F.lead("days", k).over(pw()) for k in range(1, 5)}).withColumns({"r0": F.col("ret"), "n0": F.col("days")})
    x = x.withColumn("all", sum((F.col(f"n{k}") for k in range(1, 5)), F.col("n0")))
    up = x.where("r0 > 0 and r1 < 0 and r2 > 0 and r3 < 0 and r4 > 0 and all > 0").groupBy("symbol").agg(*[F.avg(F.col(f"n{k}") / F.col("all")).alias(f"f{k + 1}") for k in range(5)])
    none = (0.20, 0.15, 0.30, 0.15, 0.20)
    return l.select("symbol").distinct().join(up, "symbol", "left").select("symbol", *[(0.5 * F.coalesce(f"f{k + 1}", F.lit(none[k])) + 0.5 * PRIOR_TIME[k]).alias(f"f{k + 1}") for k in range(5)])


_TIMES = """, lt0 as (select symbol, ret as r0, days as n0, """ + ", ".join(f"lead(ret, {k}) over w as r{k}, lead(days, {k}) over w as n{k}" for k in range(1, 5)) + """ from legs window w as (partition by symbol order by pno)),
lt1 as (select *, n0 + n1 + n2 + n3 + n4 as total from lt0), lt2 as (select symbol, """ + ", ".join(f"avg(n{k} / total::double) as f{k + 1}" for k in range(5)) + """ from lt1 where r0 > 0 and r1 < 0 and r2 > 0 and r3 < 0 and r4 > 0 and total > 0 group by 1),
lt as (select s.symbol, """ + ", ".join(f"0.5::double * coalesce(f{k + 1}, {(0.20, 0.15, 0.30, 0.15, 0.20)[k]}::double) + 0.5::double * {PRIOR_TIME[k]}::double as f{k + 1}" for k in range(5)) + """ from (select distinct symbol from legs) s left join lt2 using (symbol))"""
_TC = [{"wave": str(k), "share": rounded(" + ".join(f"f{j}" for j in range(1, k + 1)), 6)} for k in range(1, 6)]


@query("subwave_times", zsql(LEGS + _TIMES + " " + sql_rows("lt", _TC)))
def subwave_times(spark, sf_dir):
    """Cumulated share of wave 5's time at the end of each of its parts."""
    return spark_rows(leg_times(legs(zigzag(bars(spark, sf_dir)))), _TC)


# --------------------------------------------------------------------------------------------------- dated targets
def dated_targets(b: DataFrame, z: DataFrame) -> DataFrame:
    """symbol, cat, name, price, expect, close: the sell targets and the parts of wave 5, with the bars that they are expected to
    take: by history's legs for the sells, by share of the first sell's time for the parts."""
    z = kept(z)
    x, l = kept(wave_labels(b, z)), kept(legs(z))
    sells = spark_rows(x, [{"name": f"'{n}'", "price": rounded(e)} for n, e in SELLS.items()], ("symbol", "close"))
    sells = time_to_reach(sells.withColumn("need", F.ln(F.col("price") / F.col("close"))), l, ["name", "price", "close", "need"])
    sells = kept(sells).select("symbol", F.lit("sell").alias("cat"), "name", "price", F.col("bars").alias("expect"), "close")
    times = spark_rows(leg_times(l), [{"wave": str(k), "share": " + ".join(f"f{j}" for j in range(1, k + 1))} for k in range(1, 6)])
    first = sells.where("name = 'sell 1'").select("symbol", F.col("expect").alias("all_bars"), "close")
    parts = subwave_prices(x.join(model_in_use(b, z), "symbol")).join(times, ["symbol", "wave"]).join(first, "symbol")
    parts = parts.select("symbol", F.lit("part"), F.concat(F.lit("part "), F.col("wave").cast("string")), "price", F.greatest(F.lit(1), F.bround(F.col("share") * F.col("all_bars"))).cast("int"), "close")
    return sells.union(parts)


DATED = _model_sql() + LABELS + _SUBSQL + _TIMES + ", dz as (" + sql_rows("wp", [{"name": f"'{n}'", "price": rounded(e)} for n, e in SELLS.items()], ("symbol", "close")) + """), dn as (select *, ln(price / close) as need from dz),
dj as (select d.*, l.days * (abs(need) / abs(l.ret)) as ttr, abs(l.ret) >= abs(need) as big, row_number() over (partition by d.symbol, d.name order by abs(abs(l.ret) - abs(need)), l.pno) as k from dn d join legs l on l.symbol = d.symbol and sign(l.ret) = sign(need)),
db as (select symbol, name, list_sort(list(ttr) filter (big)) as l, avg(ttr) filter (k <= 5) as mean from dj group by 1, 2),
ds as (select d.symbol, 'sell' as cat, d.name, d.price, greatest(10, least(330, round_even(coalesce(case when len(l) >= 4 then l[len(l) // 2 + 1] else mean end, 330), 0)))::int as expect, close from dn d left join db using (symbol, name)),
dp as (select s.symbol, 'part' as cat, 'part ' || wave as name, s.price, greatest(1, round_even(share * expect, 0))::int as expect, ds.close from sp5 s join (""" + sql_rows("lt", [{"wave": str(k), "share": " + ".join(f"f{j}" for j in range(1, k + 1))} for k in range(1, 6)]) + """) t using (symbol, wave) join ds on ds.symbol = s.symbol and ds.name = 'sell 1'),
dated as materialized (select * from ds union all select * from dp)"""


@query("dated_targets", zsql(DATED + " select symbol, cat, name, price, expect from dated"))
def dated_targets_query(spark, sf_dir):
    """All targets to be written down: two kinds, one table."""
    b = bars(spark, sf_dir)
    return dated_targets(b, zigzag(b)).drop("close")
