"""First-passage probabilities, walk-forward calibration, back-tests.

Samples are the product of each bar with a small fixed grid (horizons, amplitudes, directions); they are made by
explode, never by a join, and aggregated at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by, first_passage_sql, normal_cdf_sql, with_total
from ..functions.isotonic import pools
from ..plans.registry import query
from ..sources.bars import bars
from ..sources.shared import kept, shared_folder
from ..streaming.commits import KeyedLog
from .indicators import PIT, RET, TERM, WINDOWS, band_scale, expanding_rank, hv20, interpolated, term_structure, with_returns

P = "partition by symbol order by i"
#: The grid of the samples: every bar from the first whose shortest volatility window is full, 84 samples a bar.
GRID_HORIZONS, GRID_AMPLITUDES, GRID_FIRST = (20, 40, 60, 90, 120, 180, 250), (0.03, 0.05, 0.08, 0.12, 0.15, 0.20), 20
HORIZONS, AMPLITUDES, STEP, FIRST = GRID_HORIZONS, GRID_AMPLITUDES, 1, GRID_FIRST


@query("normal_cdf_grid", f"{RET}, x as (select symbol, i, round(ret * 100, 4) as x from rt where ret is not null) select symbol, i, x + 0.0 as x, round({normal_cdf_sql('x')}, 6) as cdf from x", bars=True)
def normal_cdf_grid(spark, sf_dir):
    """The normal distribution function at every bar's return, in percent."""
    x = with_returns(bars(spark, sf_dir)).where("ret is not null").select("symbol", "i", F.round(F.col("ret") * 100, 4).alias("x"))
    return x.selectExpr("symbol", "i", "x + 0.0D as x", f"round({normal_cdf_sql('x')}, 6) as cdf")


@query("first_passage_grid", f"{RET}, m as (select symbol, round(avg(ret), 6) as mu, round(stddev_samp(ret), 6) as sigma from rt group by 1), g as (select symbol, mu, sigma, (k - 5) / 20.0::double as a, h * 40.0::double as t from m, (select unnest(generate_series(0, 10)) as k), (select unnest(generate_series(1, 3)) as h)) select symbol, round(a, 4) + 0.0 as a, t, round({first_passage_sql('a', 'mu', 'sigma', 't')}, 5) as p from g", bars=True)
def first_passage_grid(spark, sf_dir):
    """Chances of reaching distances of up to half, with the drift and deviation of each symbol's bars."""
    m = with_returns(bars(spark, sf_dir)).groupBy("symbol").agg(F.round(F.avg("ret"), 6).alias("mu"), F.round(F.stddev_samp("ret"), 6).alias("sigma"))
    g = m.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(3)))).selectExpr("symbol", "mu", "sigma", "(k - 5) / 20.0D as a", "h * 40.0D as t")
    return g.selectExpr("symbol", "round(a, 4) + 0.0D as a", "t", f"round({first_passage_sql('a', 'mu', 'sigma', 't')}, 5) as p")


def at_horizon(prefix: str, h: int):
    """The term structure at a fixed horizon."""
    h = max(WINDOWS[0], min(WINDOWS[-1], h))
    if h in WINDOWS:  # needs no other window to be full
        return F.col(f"{prefix}{h}")
    a, b = next((a, b) for a, b in zip(WINDOWS, WINDOWS[1:]) if h <= b)
    t = (h - a) / (b - a)
    return F.col(f"{prefix}{a}") * (1 - t) + F.col(f"{prefix}{b}") * t


def calibration_samples(b: DataFrame, horizons=GRID_HORIZONS, amplitudes=GRID_AMPLITUDES, step: int = 1, first: int = GRID_FIRST) -> DataFrame:
    """symbol, i, h, r, dir, p (model, before the fact), y (whether the barrier was reached within h bars).

    The band moves the barrier towards the price; a barrier that the price has already passed has p = 1. A bar needs
    max(horizons) bars after it, and has no samples of a horizon whose volatility windows are not full or have none."""
    x = term_structure(b)
    for h in horizons:
        w = by().rowsBetween(1, h)
        x = x.withColumns({f"hi{h}": F.max("high").over(w), f"lo{h}": F.min("low").over(w)})
    rank = expanding_rank(hv20(b), "hv", "pct").select("symbol", "i", band_scale(F.col("pct")).alias("scale"))
    x = x.withColumn("n", F.max("i").over(Window.partitionBy("symbol"))).where((F.col("i") >= first) & (F.col("i") % step == 0) & (F.col("i") + max(horizons) <= F.col("n"))).join(rank, ["symbol", "i"])
    # everything that depends on the horizon alone is made before its explode, the barrier in that of the amplitudes
    x = x.withColumn("g", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"hi{h}").alias("hi"), F.col(f"lo{h}").alias("lo"), at_horizon("s", h).alias("sigma"), at_horizon("m", h).alias("mu")) for h in horizons])))
    x = x.select("symbol", "i", "close", "scale", "g.*").where("sigma > 0")
    bar = lambda r, d: F.expr(f"close * (1 + {d} * {r}D) * (1 - {d} * least(sigma * sqrt(h) * scale, 0.235D))")
    x = x.withColumn("a", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(d).alias("dir"), bar(r, d).alias("bar")) for r in amplitudes for d in (1, -1)])))
    x = x.select("symbol", "i", "close", "h", "hi", "lo", "sigma", "mu", "a.*")
    p = f"case when (close - bar) * dir >= 0 then 1.0D else {first_passage_sql('ln(bar / close)', 'mu', 'sigma', 'cast(h as double)')} end"
    y = "case when dir = 1 then hi >= bar else lo <= bar end"
    # a second explode, of one element, keeps the probability from being inlined wherever p is used
    x = x.withColumns({"p": F.expr(f"round(greatest(0.001D, least(0.999D, {p})), 6)"), "y": F.expr(f"cast({y} as int)")})
    return x.select("symbol", "i", "h", "r", "dir", F.explode(F.array(F.struct("p", "y"))).alias("o")).select("symbol", "i", "h", "r", "dir", "o.p", "o.y")


_FWD = ", ".join(f"max(high) over ({P} rows between 1 following and {h} following) as hi{h}, min(low) over ({P} rows between 1 following and {h} following) as lo{h}" for h in HORIZONS)
_PICK = lambda k: "case " + " ".join(f"when h = {h} then {k}{h}" for h in HORIZONS) + " end"


def sql_at(prefix: str, h: int) -> str:
    """at_horizon for DuckDB."""
    if h in WINDOWS:
        return f"{prefix}{h}"
    lo, hi = next((x, y) for x, y in zip(WINDOWS, WINDOWS[1:]) if h <= y)
    t = (h - lo) / (hi - lo)
    return f"{prefix}{lo} * {1 - t!r}::double + {prefix}{hi} * {t!r}::double"


_AT = lambda k: "case " + " ".join(f"when h = {h} then {sql_at(k, h)}" for h in HORIZONS) + " end"
VOL = f"{PIT}{TERM.replace(', rt as', ', rt2 as').replace('from rt)', 'from rt2)')}"
SAMPLES = f"""{VOL}, fw as (select *, {_FWD}, max(i) over (partition by symbol) as n from term),
sm0 as (select f.symbol, f.i, close, case when p >= 66 then 1.15 when p >= 33 then 1.0 else 0.88 end::double as scale, h, r::double as r, dir, {_PICK('hi')} as hi, {_PICK('lo')} as lo,
  {_AT('s')} as sigma, {_AT('m')} as mu from fw f join pit using (symbol, i), (select unnest({list(HORIZONS)}) as h), (select unnest({list(AMPLITUDES)}) as r), (select unnest([1, -1]) as dir)
  where f.i >= {FIRST} and f.i % {STEP} = 0 and f.i + {max(HORIZONS)} <= n),
sm1 as (select *, close * (1 + dir * r) * (1 - dir * least(sigma * sqrt(h) * scale, 0.235)) as bar from sm0 where sigma > 0),
samples as (select symbol, i, h, r, dir, round(greatest(0.001, least(0.999, case when (close - bar) * dir >= 0 then 1.0 else {first_passage_sql('ln(bar / close)', 'mu', 'sigma', 'h::double')} end)), 6) as p,
  (case when dir = 1 then hi >= bar else lo <= bar end)::int as y from sm1) """


@query("calibration_samples", SAMPLES + "select symbol, i, h::int as h, r, dir::int as dir, floor(p * 10000 + 0.001)::int as p4, y from samples", bars=True)
def calibration_samples_query(spark, sf_dir):
    return calibration_samples(bars(spark, sf_dir)).select("symbol", "i", "h", "r", "dir", F.floor(F.col("p") * 10000 + 0.001).cast("int").alias("p4"), "y")


#: The logit of p, for both engines.
Z = "ln(p / (1 - p))"


def bucket(p="p"):
    return F.least(F.floor(F.col(p) * 10), F.lit(9)).cast("int")


@query("calibration_bins", SAMPLES + "select least(floor(p * 10), 9)::int as bin, count(*) as n, round(avg(p), 4) as model, round(avg(y), 4) as realized from samples group by 1", bars=True)
def calibration_bins(spark, sf_dir):
    return calibration_samples(bars(spark, sf_dir)).groupBy(bucket().alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("model"), F.round(F.avg("y"), 4).alias("realized"))


@query("calibration_slope", SAMPLES + "select count(*) as n, round(avg((p - y) * (p - y)), 5) as brier, round(regr_slope(y, ln(p / (1 - p))), 5) as slope, round(regr_intercept(y, ln(p / (1 - p))), 5) as intercept from samples", bars=True)
def calibration_slope(spark, sf_dir):
    """Brier score and the line of outcomes on the logit (which is also the Platt fit)."""
    s = calibration_samples(bars(spark, sf_dir))
    z = F.ln(F.col("p") / (1 - F.col("p")))
    return s.agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 5).alias("brier"), F.round(F.regr_slope("y", z), 5).alias("slope"), F.round(F.regr_intercept("y", z), 5).alias("intercept"))


@query("temperature_scaling", SAMPLES + ", t as (select k, 0.5 + k * 0.05::double as temp from (select unnest(generate_series(0, 30)) as k)), b as (select k, any_value(temp) as temp, round(avg(power(1 / (1 + exp(-ln(p / (1 - p)) / temp)) - y, 2)), 6) as brier from samples, t group by 1) select round(arg_min(temp, (brier, k)), 4) as temperature, min(brier) as brier from b", bars=True)
def temperature_scaling(spark, sf_dir):
    s = calibration_samples(bars(spark, sf_dir)).select("p", "y", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("k"))
    temp = 0.5 + F.col("k") * 0.05
    s = s.groupBy("k").agg(F.round(F.avg(F.pow(1 / (1 + F.exp(-F.ln(F.col("p") / (1 - F.col("p"))) / temp)) - F.col("y"), 2)), 6).alias("brier"))
    return s.agg(F.round(F.min_by(0.5 + F.col("k") * 0.05, F.struct("brier", "k")), 4).alias("temperature"), F.min("brier").alias("brier"))


def pava(bins: DataFrame) -> DataFrame:
    """Weighted isotonic values of at most ten bins (bin, n, v) in closed form: max over a <= i of min over b >= i of the mean."""
    a, b, i = (bins.select(F.col("bin").alias(x)) for x in "abi")
    span = a.join(b, F.col("a") <= F.col("b")).join(bins, F.expr("bin between a and b")).groupBy("a", "b").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("m"))
    low = span.join(i, F.expr("i between a and b")).groupBy("i", "a").agg(F.min("m").alias("m"))
    return low.groupBy(F.col("i").alias("bin")).agg(F.max("m").alias("iso"))


RECAL = SAMPLES + ", rb as (select least(floor(p * 10), 9)::int as bin, count(*) as n, case when count(*) >= 40 then (sum(y) + 2.5) / (count(*) + 5) else (least(floor(p * 10), 9) + 0.5) / 10 end as v from samples group by least(floor(p * 10), 9)), sp as (select a.bin as a, b.bin as b, sum(c.n * c.v) / sum(c.n) as m from rb a join rb b on a.bin <= b.bin join rb c on c.bin between a.bin and b.bin group by 1, 2), iso as (select bin, max(m) as iso from (select i.bin, sp.a, min(sp.m) as m from rb i join sp on i.bin between sp.a and sp.b group by 1, 2) group by 1) "
RECAL_AT = RECAL + ", rq as (select s.*, case when p >= 0.98 then p else coalesce(iso, p) end as q from samples s left join iso on bin = least(floor(p * 10), 9)::int)"


def recalibration(samples: DataFrame) -> DataFrame:
    """bin, n, v (shrunk rate, or the middle of the bin below 40 samples), iso."""
    n = F.count("*")
    rb = samples.groupBy(bucket().alias("bin")).agg(n.alias("n"), F.sum("y").alias("s")).select("bin", "n", F.when(F.col("n") >= 40, (F.col("s") + 2.5) / (F.col("n") + 5)).otherwise((F.col("bin") + 0.5) / 10).alias("v"))
    return rb.join(pava(rb), "bin")


@query("bucket_recal", RECAL + "select rb.bin, n, round(v, 6) as v, round(iso, 6) as iso from rb join iso using (bin)", bars=True)
def bucket_recal(spark, sf_dir):
    return recalibration(calibration_samples(bars(spark, sf_dir))).select("bin", "n", F.round("v", 6).alias("v"), F.round("iso", 6).alias("iso"))


SPLIT = SAMPLES + ", sr as (select *, dense_rank() over (partition by symbol order by i) as k from samples), sc as (select *, k <= 0.6 * max(k) over (partition by symbol) as train from sr), tr as (select least(floor(p * 10), 9)::int as bin, count(*) as n, avg(y) as v from sc where train group by 1) "
_ISO = ", sp as (select a.bin as a, b.bin as b, sum(c.n * c.v) / sum(c.n) as m from tr a join tr b on a.bin <= b.bin join tr c on c.bin between a.bin and b.bin group by 1, 2), iso as (select bin, max(m) as iso from (select i.bin, sp.a, min(sp.m) as m from tr i join sp on i.bin between sp.a and sp.b group by 1, 2) group by 1) "
_WINNER = "case least(raw, bucketed, platt, pava) when raw then 'raw' when bucketed then 'bucketed' when platt then 'platt' else 'pava' end"


def split_samples(samples: DataFrame) -> DataFrame:
    """Samples with `train`: the first 60 percent of each symbol's anchors."""
    s = samples.withColumn("k", F.dense_rank().over(by()))
    return s.withColumn("train", F.col("k") <= 0.6 * F.max("k").over(Window.partitionBy("symbol"))).withColumn("bin", bucket())


def platt(samples: DataFrame) -> DataFrame:
    """slope and intercept of outcomes on the logit, by least squares: one row."""
    return samples.agg(F.regr_slope("y", F.expr(Z)).alias("slope"), F.regr_intercept("y", F.expr(Z)).alias("intercept"))


@query("oos_brier_split", SPLIT + _ISO + f", pl as (select regr_slope(y, {Z}) as slope, regr_intercept(y, {Z}) as intercept from sc where train), ob as (select count(*) as n, round(avg(power(p - y, 2)), 5) as raw, round(avg(power(coalesce(v, p) - y, 2)), 5) as bucketed, round(avg(power(1 / (1 + exp(-(slope * {Z} + intercept))) - y, 2)), 5) as platt, round(avg(power(coalesce(iso, p) - y, 2)), 5) as pava from pl, sc left join tr on least(floor(p * 10), 9)::int = tr.bin left join iso on iso.bin = tr.bin where not train) select *, {_WINNER} as winner from ob", bars=True)
def oos_brier_split(spark, sf_dir):
    """Brier scores on the later 40 percent of anchors: raw, with the rates of ten buckets of the earlier 60 percent, with the
    line on the logit, with isotonic bucket rates; and which is best."""
    s = split_samples(calibration_samples(bars(spark, sf_dir)))
    rates = s.where("train").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("v"))
    t = s.where("not train").join(rates.join(pava(rates), "bin").select("bin", "v", "iso"), "bin", "left").crossJoin(platt(s.where("train")))  # one row
    brier = lambda p: F.round(F.avg(F.pow(p - F.col("y"), 2)), 5)
    x = t.agg(F.count("*").alias("n"), brier(F.col("p")).alias("raw"), brier(F.coalesce("v", "p")).alias("bucketed"), brier(F.expr(f"1 / (1 + exp(-(slope * {Z} + intercept)))")).alias("platt"), brier(F.coalesce("iso", "p")).alias("pava"))
    return x.withColumn("winner", F.expr(_WINNER))


@query("bucket_train", SPLIT + ", ft as (select k::int as bin, v, coalesce(n, 0) as n from (select unnest(generate_series(0, 9)) as k) left join (select * from tr where n >= 40) on bin = k) select bin, n, round(coalesce(v, last_value(v ignore nulls) over (order by bin rows between unbounded preceding and current row), first_value(v ignore nulls) over (order by bin rows between current row and unbounded following)), 6) as v from ft", bars=True)
def bucket_train(spark, sf_dir):
    """Bucket rates of the earlier anchors; buckets with fewer than 40 samples take the next lower one's rate, else the next
    higher one's. Ten rows are windowed."""
    s = split_samples(calibration_samples(bars(spark, sf_dir))).where("train")
    rates = s.groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("v")).where("n >= 40")
    x = spark.range(10).select(F.col("id").cast("int").alias("bin")).join(rates, "bin", "left")
    w = Window.partitionBy(F.lit(1)).orderBy("bin")
    low, high = F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return x.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("v", low, high), 6).alias("v"))


@query("recalibrated", RECAL_AT + " select symbol, h::int as h, r, dir::int as dir, count(*) as n, round(avg(q), 5) as q from rq group by 1, 2, 3, 4", bars=True)
def recalibrated_query(spark, sf_dir):
    """Samples with their calibrated probability, summed up by symbol and grid point."""
    s = calibration_samples(bars(spark, sf_dir))
    return recalibrated(s, recalibration(s)).groupBy("symbol", "h", "r", "dir").agg(F.count("*").alias("n"), F.round(F.avg("q"), 5).alias("q"))


def recalibrated(x: DataFrame, table_: DataFrame) -> DataFrame:
    """Adds q: the isotonic rate of p's bucket; p itself from 0.98 on and where the bucket is not known. Ten rows are joined."""
    t = table_.select(F.col("bin").alias("bin_"), F.col("iso").alias("iso_"))
    return x.join(F.broadcast(t), bucket() == F.col("bin_"), "left").withColumn("q", F.expr("case when p >= 0.98D then p else coalesce(iso_, p) end")).drop("bin_", "iso_")


_STEP_ISO = """, sg as (select floor(p * 100 + 1e-7)::int as g, count(*) as n, sum(y) as s from samples group by 1), cu as (select g, row_number() over (order by g) as k, n, s, sum(n) over (order by g) as cn, sum(s) over (order by g) as cs from sg),
pr as (select a.k as a, b.k as b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)::double as m from cu a join cu b on a.k <= b.k),
lw as (select a, b, min(m) over (partition by a order by b rows between current row and unbounded following) as m from pr) """


@query("isotonic_steps", SAMPLES + _STEP_ISO + "select any_value(g) as hundredths, any_value(n) as n, round(max(m), 5) as iso from lw join cu on b = k group by b", bars=True)
def isotonic_steps(spark, sf_dir):
    """Isotonic regression of outcomes on the probability in steps of a hundredth (at most 101 steps): the largest, over starts
    up to a step, of the least mean of the stretches that begin there and reach the step or go beyond."""
    g = calibration_samples(bars(spark, sf_dir)).groupBy(F.floor(F.col("p") * 100 + 1e-7).cast("int").alias("g")).agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    w = Window.partitionBy(F.lit(1)).orderBy("g")  # at most 101 rows
    cu = g.select("g", "n", "s", F.row_number().over(w).alias("k"), F.sum("n").over(w).alias("cn"), F.sum("s").over(w).alias("cs"))
    a = cu.select(F.col("k").alias("a"), F.col("n").alias("an"), F.col("s").alias("as_"), F.col("cn").alias("acn"), F.col("cs").alias("acs"))
    pr = a.join(cu, F.col("a") <= F.col("k")).withColumn("m", (F.col("cs") - F.col("acs") + F.col("as_")) / (F.col("cn") - F.col("acn") + F.col("an")))
    low = F.min("m").over(Window.partitionBy("a").orderBy("k").rowsBetween(0, Window.unboundedFollowing))
    return pr.withColumn("low", low).groupBy("k").agg(F.first("g").alias("hundredths"), F.first("n").alias("n"), F.round(F.max("low"), 5).alias("iso")).drop("k")


@query("isotonic_samples")
def isotonic_samples(spark, sf_dir):
    """Isotonic regression of outcomes on all samples of each symbol, on the probability in ten-thousandths: its steps. A test
    restates it plainly; SQL has no pooling."""
    x = calibration_samples(bars(spark, sf_dir))
    x = pools(x, F.floor(F.col("p") * 10000 + 0.001), F.col("y"))
    return x.select("symbol", "no", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), "n", F.round("value", 6).alias("value"))


@query("dominant_tier", SAMPLES + ", tb as (select least(floor(p * 10), 9)::int as bin, h, r, dir, count(*) as n, sum(p) as sp, sum(y) as sy from samples group by 1, 2, 3, 4) select bin, sum(n)::bigint as n, arg_max(h, (n, -h, -r, dir))::int as h, arg_max(r, (n, -h, -r, dir)) as r, arg_max(dir, (n, -h, -r, dir))::int as dir, round(max(n) / sum(n), 6) as share, round((sum(sp) - sum(sy)) / sum(n), 5) + 0.0 as gap from tb group by 1", bars=True)
def dominant_tier(spark, sf_dir):
    """Of each bucket, the grid point that most samples come from, its share, and the bucket's gap."""
    t = calibration_samples(bars(spark, sf_dir)).groupBy(bucket().alias("bin"), "h", "r", "dir").agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"))
    top = F.max_by(F.struct("h", "r", "dir"), F.struct("n", -F.col("h"), -F.col("r"), "dir"))
    x = t.groupBy("bin").agg(F.sum("n").alias("n"), top.alias("t"), F.round(F.max("n") / F.sum("n"), 6).alias("share"), (F.round((F.sum("sp") - F.sum("sy")) / F.sum("n"), 5) + 0.0).alias("gap"))
    return x.select("bin", "n", "t.h", "t.r", "t.dir", "share", "gap")


@query("calib_2d", SPLIT.split(", tr as")[0] + ", tr as (select h, r, dir, avg(y) as rate from sc where train group by 1, 2, 3) select h::int as h, r, dir::int as dir, count(*) as n, round(any_value(rate), 4) as rate, round(avg(power(rate - y, 2)), 5) as brier from sc join tr using (h, r, dir) where not train group by 1, 2, 3", bars=True)
def calib_2d(spark, sf_dir):
    s = calibration_samples(bars(spark, sf_dir)).withColumn("k", F.dense_rank().over(by()))
    s = s.withColumn("train", F.col("k") <= 0.6 * F.max("k").over(Window.partitionBy("symbol")))
    rates = s.where("train").groupBy("h", "r", "dir").agg(F.avg("y").alias("rate"))
    t = s.where("not train").join(rates, ["h", "r", "dir"])
    return t.groupBy("h", "r", "dir").agg(F.count("*").alias("n"), F.round(F.first("rate"), 4).alias("rate"), F.round(F.avg(F.pow(F.col("rate") - F.col("y"), 2)), 5).alias("brier"))


_COARSE = "*, case when h <= 60 then 'short' when h <= 120 then 'middle' else 'long' end as span, case when r <= 0.05 then 'near' when r <= 0.12 then 'middle' else 'far' end as reach"


@query("brier_grouping_sets", SAMPLES + f"select h::int as h, r, span, reach, count(*) as n, round(avg(power(p - y, 2)), 5) as brier, round(avg(p) - avg(y), 5) + 0.0 as gap, round(regr_slope(y, {Z}), 5) as slope from (select {_COARSE} from samples) group by grouping sets ((h), (r), (span), (reach), ())", bars=True)
def brier_grouping_sets(spark, sf_dir):
    """Brier score, gap and slope by horizon, amplitude, coarse horizon, coarse amplitude, and over all, in one pass."""
    s = calibration_samples(bars(spark, sf_dir)).selectExpr(*_COARSE.replace("0.05", "0.05D").replace("0.12", "0.12D").split(", "))
    return with_total(s, [["h"], ["r"], ["span"], ["reach"]], F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 5).alias("brier"), (F.round(F.avg("p") - F.avg("y"), 5) + 0.0).alias("gap"), F.round(F.regr_slope("y", F.expr(Z)), 5).alias("slope"))


@query("low_bucket_bias", SAMPLES + "select count(*) as n, round(avg(p), 5) as p, round(avg(y), 5) as y, round(avg(p) - avg(y), 5) + 0.0 as gap from samples where p < 0.2", bars=True)
def low_bucket_bias(spark, sf_dir):
    s = calibration_samples(bars(spark, sf_dir)).where("p < 0.2D")
    return s.agg(F.count("*").alias("n"), F.round(F.avg("p"), 5).alias("p"), F.round(F.avg("y"), 5).alias("y"), (F.round(F.avg("p") - F.avg("y"), 5) + 0.0).alias("gap"))


# ------------------------------------------------------------------------------------------------- back-tests
#: (percent, bars): prices are made in whole cents, so that both engines round alike.
TARGETS = ((2, 20), (-2, 20), (5, 60), (-5, 60), (8, 120), (-8, 120))
FRAC = 0.005


def target_log(b: DataFrame, every: int = 20) -> DataFrame:
    """symbol, i, key, side, price, expect: targets written down on every 20th bar."""
    x = b.where((F.col("i") % every == 0)).withColumn("t", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("expect")) for m, d in TARGETS])))
    return x.select("symbol", "i", F.concat(F.when(F.col("t.m") > 0, "up").otherwise("down"), F.abs("t.m").cast("string")).alias("key"), F.when(F.col("t.m") > 0, "sell").otherwise("buy").alias("side"), F.expr("((cast(round(close * 100) as bigint) * (100 + t.m) + 50) div 100) / 100.0D").alias("price"), F.col("t.expect").alias("expect"))


TLOG = ", tlog as (select symbol, i, case when m > 0 then 'up' else 'down' end || abs(m)::varchar as key, case when m > 0 then 'sell' else 'buy' end as side, ((cast(round(close * 100) as bigint) * (100 + m) + 50) // 100) / 100.0::double as price, e as expect from bars, (select * from (values " + ", ".join(f"({m}, {d})" for m, d in TARGETS) + ") v(m, e)) where i % 20 = 0) "


def banded(log: DataFrame, b: DataFrame) -> DataFrame:
    """Adds frac, the half width of the band of a target as of its own bar: deviation over the horizon times the scale of the
    volatility regime, at most 0.235; 0 before there is a deviation."""
    t = term_structure(b)
    vol = t.join(expanding_rank(hv20(b), "hv", "pct").select("symbol", "i", F.when(F.col("pct").isNull(), 1.0).otherwise(band_scale(F.col("pct"))).alias("scale")), ["symbol", "i"]).select("symbol", "i", "scale", *[f"s{w}" for w in WINDOWS])
    # a horizon that is a window needs no other window to be full
    sigma = F.coalesce(*[F.when(F.col("expect") == w, F.col(f"s{w}")) for w in WINDOWS], interpolated({w: f"s{w}" for w in WINDOWS}, F.col("expect")))
    return log.join(vol, ["symbol", "i"]).select(*log.columns, F.coalesce(F.least(sigma * F.sqrt("expect") * F.col("scale"), F.lit(0.235)), F.lit(0.0)).alias("frac"))


def evaluate(log: DataFrame, b: DataFrame, block: int = 64) -> DataFrame:
    """Adds days, state (hit, miss, pending). A target is hit whenever its band (frac, or FRAC) is reached later; it is missed
    only once its window has closed. The first hit is looked for in the rest of the bar's own block of `block` bars, then
    among the extremes of later blocks, then in the first block that reaches it; no later hits are kept."""
    n = b.groupBy("symbol").agg(F.max("i").alias("n"))
    if "frac" not in log.columns:
        log = log.withColumn("frac", F.lit(FRAC))
    reach = lambda hi, lo: F.expr(f"(side = 'sell' and {hi} >= price * (1 - frac)) or (side = 'buy' and {lo} <= price * (1 + frac))")
    of = lambda c: F.floor(F.col(c) / block)
    bar = b.select(F.col("symbol").alias("s"), F.col("i").alias("j"), of("i").alias("k"), "high", "low")
    blocks = bar.groupBy("s", "k").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    same = F.col("symbol") == F.col("s")
    own = log.join(bar, same & (F.col("k") == of("i")) & (F.col("j") > F.col("i")) & reach("high", "low"), "left").groupBy(*log.columns).agg(F.min("j").alias("j"))
    rest = own.where("j is null").drop("j").join(blocks, same & (F.col("k") > of("i")) & reach("high", "low"), "left").groupBy(*log.columns).agg(F.min("k").alias("at"))
    later = rest.join(bar, same & (F.col("k") == F.col("at")) & reach("high", "low"), "left").groupBy(*log.columns).agg(F.min("j").alias("j"))
    x = own.where("j is not null").union(later).join(n, "symbol")
    return x.select(*[c for c in log.columns if c != "frac"], (F.col("j") - F.col("i")).alias("days"), F.expr("case when j is not null then 'hit' when i + expect > n then 'pending' else 'miss' end").alias("state"))


BANDED = TLOG + ", tband as (select t.*, coalesce(least(case expect when 20 then s20 when 60 then s60 else s120 end * sqrt(expect) * case when p is null then 1.0 when p >= 66 then 1.15 when p >= 33 then 1.0 else 0.88 end::double, 0.235), 0)::double as frac from tlog t join term using (symbol, i) join pit on pit.symbol = t.symbol and pit.i = t.i) "
EVAL = VOL + BANDED + ", ev as (select t.*, (select min(b.i) from bars b where b.symbol = t.symbol and b.i > t.i and ((side = 'sell' and high >= price * (1 - frac)) or (side = 'buy' and low <= price * (1 + frac)))) - t.i as days, n from tband t join (select symbol, max(i) as n from bars group by 1) using (symbol)), ev2 as (select *, case when days is not null then 'hit' when i + expect > n then 'pending' else 'miss' end as state from ev) "


@query("backtest_evaluate", EVAL + "select symbol, i, key, side, price, expect::int as expect, days, state from ev2", bars=True)
def backtest_evaluate(spark, sf_dir):
    b = bars(spark, sf_dir)
    return evaluate(banded(target_log(b), b), b)


@query("backtest_hit_rate", EVAL + "select key, count(*) as n, count(*) filter (state = 'hit') as hits, round(100.0 * (count(*) filter (state = 'hit') + 1) / (count(*) + 2), 4) as laplace, round(avg(days), 4) as avg_days, count(*) < 3 as cold from ev2 where state <> 'pending' group by 1", bars=True)
def backtest_hit_rate(spark, sf_dir):
    b = bars(spark, sf_dir)
    h = F.count_if(F.col("state") == "hit")
    return evaluate(banded(target_log(b), b), b).where("state <> 'pending'").groupBy("key").agg(F.count("*").alias("n"), h.alias("hits"), F.round(100.0 * (h + 1) / (F.count("*") + 2), 4).alias("laplace"), F.round(F.avg("days"), 4).alias("avg_days"), (F.count("*") < 3).alias("cold"))


@query("backtest_totals", EVAL + "select count(*) as logged, count(*) filter (state <> 'pending') as evaluated, count(*) filter (state = 'pending') as pending, round(100.0 * count(*) filter (state = 'hit') / count(*) filter (state <> 'pending'), 4) as realized from ev2", bars=True)
def backtest_totals(spark, sf_dir):
    b = bars(spark, sf_dir)
    s = F.col("state")
    return evaluate(banded(target_log(b), b), b).agg(F.count("*").alias("logged"), F.count_if(s != "pending").alias("evaluated"), F.count_if(s == "pending").alias("pending"), F.round(100.0 * F.count_if(s == "hit") / F.count_if(s != "pending"), 4).alias("realized"))


def upsert_log(old: DataFrame, new: DataFrame, keys=("symbol", "i", "key")) -> DataFrame:
    """The log with the new rows whose key it does not have yet; the first of repeated new rows wins."""
    first = new.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("price"))).where("_k = 1").drop("_k")
    return old.unionByName(first.join(old, list(keys), "left_anti"))


@query("target_log_dedupe", TLOG + "select key, count(*) as n, round(sum(price), 2) as total from tlog group by 1", bars=True)
def target_log_dedupe(spark, sf_dir):
    log = target_log(bars(spark, sf_dir))
    old = log.where("i % 40 = 0")
    return upsert_log(old, log.union(log)).groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("target_log_commits", TLOG + "select symbol, i, key, side, price, expect::int as expect from tlog", bars=True)
def target_log_commits(spark, sf_dir):
    """The log as three writers leave it, whose parts overlap and repeat."""
    log = kept(target_log(bars(spark, sf_dir)))
    to = KeyedLog(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}", "symbol string, i int, key string, side string, price double, expect int", ("symbol", "i", "key"))
    for part in (log.where("i % 40 = 0"), log, log.union(log)):
        to.upsert(part)
    return to.read()


@query("log_quality", TLOG + "select side, key, count(*) as n, count(*) filter (price <= 0) as bad_price, count(distinct (symbol, i)) as anchors, round(max(price) - min(price), 2) as spread from tlog group by 1, 2", bars=True)
def log_quality(spark, sf_dir):
    return target_log(bars(spark, sf_dir)).groupBy("side", "key").agg(F.count("*").alias("n"), F.count_if(F.col("price") <= 0).alias("bad_price"), F.countDistinct("symbol", "i").alias("anchors"), F.round(F.max("price") - F.min("price"), 2).alias("spread"))


@query("empirical_rates", f"{PIT}, e0 as (select bars.*, hv, ma, lead(close, 0) over ({P}) as c from (select *, avg(close) over ({P} rows between 19 preceding and current row) as ma from bars) bars join hv using (symbol, i)), lt as (select symbol, arg_max(hv, i) as hv, arg_max(close > ma, i) as above from e0 group by 1)".replace("select bars.*, hv, ma, lead(close, 0) over (" + P + ") as c from", "select bars.symbol, bars.i, bars.close, bars.ma, hv.hv, max(bars.high) over f as hi, min(bars.low) over f as lo, count(*) over f as k from").replace("join hv using (symbol, i))", f"join hv on hv.symbol = bars.symbol and hv.i = bars.i window f as (partition by bars.symbol order by bars.i rows between 1 following and 60 following))") + " select e.symbol, r::double as r, count(*) as n, round(avg((hi >= e.close * (1 + r))::int), 6) as up, round(avg((lo <= e.close * (1 - r))::int), 6) as down from e0 e join lt using (symbol), (select unnest([0.01, 0.03, 0.05]) as r) where k = 60 and e.i >= 250 and e.hv between 0.75 * lt.hv and 1.25 * lt.hv and (e.close > ma) = above group by 1, 2", bars=True)
def empirical_rates(spark, sf_dir):
    """Share of similar anchors (volatility within a quarter of today's, same side of the mean) whose next 60 bars reach r."""
    w = by().rowsBetween(1, 60)
    e = hv20(bars(spark, sf_dir)).withColumns({"ma": F.avg("close").over(by().rowsBetween(-19, 0)), "hi": F.max("high").over(w), "lo": F.min("low").over(w), "k": F.count("*").over(w)})
    today = e.groupBy("symbol").agg(F.max_by("hv", "i").alias("thv"), F.max_by(F.col("close") > F.col("ma"), "i").alias("above"))
    e = e.join(today, "symbol").where("k = 60 and i >= 250 and hv between 0.75D * thv and 1.25D * thv and (close > ma) = above")
    e = e.withColumn("r", F.explode(F.array(F.lit(0.01), F.lit(0.03), F.lit(0.05))))
    rate = lambda c: F.round(F.avg(F.expr(c).cast("int")), 6)
    return e.groupBy("symbol", "r").agg(F.count("*").alias("n"), rate("hi >= close * (1 + r)").alias("up"), rate("lo <= close * (1 - r)").alias("down"))


@query("fan_bands", f", x as (select symbol, ln(lead(close, 30) over ({P}) / close) as f from bars), s as (select symbol, avg(f) as m, quantile_cont(f, [0.05, 0.25, 0.75, 0.95]) as q from x group by 1), c as (select symbol, arg_max(close, i) as c from bars group by 1) select symbol, t::int as t, round(c * exp(m * t / 30.0 + 1.8 * (q[1] - m) * sqrt(t / 30.0)), 4) as p05, round(c * exp(m * t / 30.0 + 1.8 * (q[2] - m) * sqrt(t / 30.0)), 4) as p25, round(c * exp(m * t / 30.0), 4) as mid, round(c * exp(m * t / 30.0 + 1.8 * (q[3] - m) * sqrt(t / 30.0)), 4) as p75, round(c * exp(m * t / 30.0 + 1.8 * (q[4] - m) * sqrt(t / 30.0)), 4) as p95 from s join c using (symbol), (select unnest([5, 15, 30]) as t)", bars=True)
def fan_bands(spark, sf_dir):
    """Bands around the mean path from the empirical distribution of 30-bar returns, widened 1.8 times, growing with the root of time."""
    b = bars(spark, sf_dir)
    s = b.withColumn("f", F.ln(F.lead("close", 30).over(by()) / F.col("close"))).groupBy("symbol").agg(F.avg("f").alias("m"), F.percentile("f", [0.05, 0.25, 0.75, 0.95]).alias("q"), F.max_by("close", "i").alias("c"))
    s = s.withColumn("t", F.explode(F.array(F.lit(5), F.lit(15), F.lit(30))))
    at = lambda k: F.round(F.expr(f"c * exp(m * t / 30.0D + 1.8D * (q[{k}] - m) * sqrt(t / 30.0D))"), 4)
    return s.select("symbol", "t", at(0).alias("p05"), at(1).alias("p25"), F.round(F.expr("c * exp(m * t / 30.0D)"), 4).alias("mid"), at(2).alias("p75"), at(3).alias("p95"))


_SIG = f", sg as (select symbol, i, close, case when close > max(high) over ({P} rows between 20 preceding and 1 preceding) then 'B' when close < min(low) over ({P} rows between 20 preceding and 1 preceding) then 'S' end as kind from bars), fr as (select symbol, i, kind, h::int as h, case when kind = 'B' then 1 else -1 end * (lead(close, h::int) over (partition by symbol, h order by i) / close - 1) as ret from sg, (select unnest([5, 10, 20, 60]) as h)) "


def breakouts(b: DataFrame) -> DataFrame:
    """symbol, i, kind, h, ret: signed returns h bars after closes beyond the last 20 bars' range."""
    w = by().rowsBetween(-20, -1)
    hs = (5, 10, 20, 60)
    x = b.withColumns({"mx": F.max("high").over(w), "mn": F.min("low").over(w)} | {f"f{h}": F.lead("close", h).over(by()) / F.col("close") - 1 for h in hs})
    x = x.withColumn("kind", F.expr("case when close > mx then 'B' when close < mn then 'S' end")).where("kind is not null")
    x = x.select("symbol", "i", "kind", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"f{h}").alias("f")) for h in hs])).alias("x"))
    return x.select("symbol", "i", "kind", "x.h", (F.when(F.col("kind") == "B", 1).otherwise(-1) * F.col("x.f")).alias("ret")).where("ret is not null")


@query("signal_backtest", _SIG + "select kind, h, count(*) as n, round(avg((ret > 0)::int), 6) as win, round(avg(ret), 6) + 0.0 as ret from fr where kind is not null and ret is not null group by 1, 2", bars=True)
def signal_backtest(spark, sf_dir):
    return breakouts(bars(spark, sf_dir)).groupBy("kind", "h").agg(F.count("*").alias("n"), F.round(F.avg((F.col("ret") > 0).cast("int")), 6).alias("win"), (F.round(F.avg("ret"), 6) + 0.0).alias("ret"))


@query("signal_robustness", _SIG + ", q0 as (select *, s::int as split, 100 * i < s * (max(i) over (partition by symbol) + 1) as early from fr, (select unnest([40, 50, 60]) as s) where h = 20), q as (select * from q0 where kind is not null and ret is not null) select kind, split, count(*) filter (early) as n0, count(*) filter (not early) as n1, round(avg((ret > 0)::int) filter (not early) - avg((ret > 0)::int) filter (early), 6) + 0.0 as decay from q group by 1, 2".replace("2499 * s / 100", "25 * s"), bars=True)
def signal_robustness(spark, sf_dir):
    """Win rates before and after three split points, at 40, 50 and 60 percent of each symbol's bars."""
    b = bars(spark, sf_dir)
    n = b.groupBy("symbol").agg((F.max("i") + 1).alias("n"))
    q = breakouts(b).where("h = 20").join(n, "symbol").withColumn("split", F.explode(F.array(F.lit(40), F.lit(50), F.lit(60)))).withColumn("early", 100 * F.col("i") < F.col("split") * F.col("n"))
    win = F.expr("case when ret > 0 then 1 else 0 end")
    part = lambda e: F.avg(F.when(F.col("early") == e, win))
    return q.groupBy("kind", "split").agg(F.count_if(F.col("early")).alias("n0"), F.count_if(~F.col("early")).alias("n1"), (F.round(part(False) - part(True), 6) + 0.0).alias("decay"))
