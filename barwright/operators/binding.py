"""Probabilities of dated targets: history's rate of similar days, the first-passage prior, its calibration, the reach of past
legs, and their fusion; and the lock that recomputes what was published.

Similar days are those whose volatility is within a quarter of today's and that are on today's side of the mean of 20. What the
next `expect` bars of a day reached is read from maxima over powers of two (two of them cover any window), so windows of
any length cost one join per target and day and no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by, first_passage_sql
from ..plans.registry import query
from ..sources.bars import bars
from ..sources.shared import kept
from .alignment import breadth
from .indicators import WINDOWS, hv20, interpolated, sql_interpolated, sql_last, term_structure
from .plan import DATED, dated_targets
from .probability import EVAL, GRID_AMPLITUDES, GRID_HORIZONS, TARGETS, banded, evaluate, target_log
from .waves import legs, zigzag, zsql

# The band of similar volatility, days a rate needs, days the pool needs, weight of the prior in days.
BAND, LEAST_DAYS, LEAST_POOL, PRIOR_DAYS = (0.75, 1.25), 10, 20, 20.0
P = "partition by symbol order by i"
POWERS = tuple(1 << k for k in range(9))


def today(b: DataFrame) -> DataFrame:
    """symbol, close, n, s20..s250, m20..m250 (as of the last bar), scale and drift (by the rank of volatility in all history),
    above (the mean of 20)."""
    t = term_structure(b).withColumn("ma", F.when(F.count("close").over(by().rowsBetween(-19, 0)) == 20, F.avg("close").over(by().rowsBetween(-19, 0))))
    last = t.groupBy("symbol").agg(F.max_by(F.struct("close", *[f"{x}{w}" for x in "sm" for w in WINDOWS], (F.col("close") > F.col("ma")).alias("above")), "i").alias("x"), F.max("i").alias("n"))
    h = hv20(b).select("symbol", "i", "hv")
    now = h.groupBy("symbol").agg(F.max_by("hv", "i").alias("now"))
    rank = h.join(now, "symbol").groupBy("symbol").agg((100.0 * F.count_if(F.col("hv") < F.col("now")) / F.count("hv")).alias("pct"))
    x = last.select("symbol", "n", "x.*").join(rank, "symbol")
    return x.withColumns({"scale": F.expr("case when pct >= 66 then 1.15D when pct >= 33 then 1.0D else 0.88D end"), "drift": F.expr("case when pct >= 66 then 0.6D when pct >= 33 then 0.85D else 1.0D end")})


TODAY = f""", ts0 as (select symbol, i, close, ln(close / lag(close) over ({P})) as ret from bars),
ts1 as (select *, {', '.join(f"{sql_last('stddev_samp', 'ret', w)} as s{w}, {sql_last('avg', 'ret', w)} as m{w}" for w in WINDOWS)}, {sql_last('avg', 'close', 20)} as ma, round({sql_last('stddev_samp', 'ret', 20)} * {244**0.5!r} * 100, 6) as hv from ts0),
ts2 as (select symbol, max(i) as n, arg_max(close, i) as close, {', '.join(f'arg_max({x}{w}, i) as {x}{w}' for x in 'sm' for w in WINDOWS)}, arg_max(close > ma, i) as above, arg_max(hv, i) as now from ts1 group by 1),
td as (select ts2.*, case when pct >= 66 then 1.15 when pct >= 33 then 1.0 else 0.88 end::double as scale, case when pct >= 66 then 0.6 when pct >= 33 then 0.85 else 1.0 end::double as drift
  from ts2 join (select t.symbol, 100.0 * count(*) filter (t.hv < l.now) / count(t.hv) as pct from ts1 t join ts2 l using (symbol) group by 1) using (symbol))"""


def sigma_of(h) -> F.col:
    return interpolated({w: f"s{w}" for w in WINDOWS}, h)


def drift_of(h) -> F.col:
    return interpolated({w: f"m{w}" for w in WINDOWS}, h) * F.col("drift")


FRAC = "least(sigma * sqrt(h) * scale, 0.235e0)"


def priced(t: DataFrame, now: DataFrame) -> DataFrame:
    """Adds to targets (symbol, price, expect, ...) today's columns, h (expect, 10 at least), sigma, mu, frac, dir."""
    x = t.drop("close").join(now, "symbol").withColumn("h", F.greatest(F.lit(10), F.col("expect")).cast("double"))
    x = x.withColumns({"sigma": sigma_of(F.col("h")), "mu": drift_of(F.col("h")), "dir": F.when(F.col("price") >= F.col("close"), 1).otherwise(-1)})
    return x.withColumn("frac", F.expr(FRAC))


_PASS = f"case when (close - bar) * dir >= 0 then 1e0 else {first_passage_sql('ln(bar / close)', 'mu', 'sigma', 'h')} end"


def prior(x: DataFrame) -> DataFrame:
    """Adds raw: the chance that the target's band is reached within h bars of a walk with today's drift and deviation."""
    return x.withColumn("bar", F.expr("price * (1 - dir * frac)")).withColumn("raw", F.expr(_PASS))


# ------------------------------------------------------------------------------------------------ rates of similar days
def windows_ahead(b: DataFrame) -> DataFrame:
    """symbol, i, p, hi, lo: extremes of the p bars after bar i, for powers of two p."""
    x = b
    for p in POWERS:
        w = by().rowsBetween(1, p)
        x = x.withColumns({f"hi{p}": F.max("high").over(w), f"lo{p}": F.min("low").over(w)})
    return x.select("symbol", "i", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"hi{p}").alias("hi"), F.col(f"lo{p}").alias("lo")) for p in POWERS])).alias("x")).select("symbol", "i", "x.*")


def similar_days(b: DataFrame, now: DataFrame) -> DataFrame:
    """symbol, i, close of the days like today."""
    t = term_structure(b).withColumn("ma", F.when(F.count("close").over(by().rowsBetween(-19, 0)) == 20, F.avg("close").over(by().rowsBetween(-19, 0)))).select("symbol", "i", "close", "s20", "ma")
    n = now.select("symbol", F.col("s20").alias("now"), "above")
    return t.join(n, "symbol").where((F.col("s20") >= BAND[0] * F.col("now")) & (F.col("s20") <= BAND[1] * F.col("now")) & ((F.col("close") > F.col("ma")) == F.col("above"))).select("symbol", "i", "close")


def rates(x: DataFrame, b: DataFrame, days: DataFrame) -> DataFrame:
    """symbol, cat, name, rate (percent), days: of priced targets, the share of similar days (with a whole window of `expect`
    bars after them) whose band at the same distance was reached. Null where the pool or the days are too few."""
    t = x.select("symbol", "cat", "name", (F.col("price") / F.col("close")).alias("ratio"), "expect", "dir", F.expr("least(s_exp * sqrt(expect) * scale, 0.235D)").alias("frac"), "n")
    t = t.withColumn("p", F.expr("cast(power(2, floor(log2(expect))) as int)"))
    pool = days.groupBy("symbol").agg(F.count("*").alias("pool"))
    d = days.select("symbol", "i", F.col("close").alias("base"))
    m = windows_ahead(b)
    one, two = m.withColumnsRenamed({"hi": "hi1", "lo": "lo1"}), m.select("symbol", F.col("i").alias("j"), "p", F.col("hi").alias("hi2"), F.col("lo").alias("lo2"))
    y = t.join(d, "symbol").where("i + expect <= n").withColumn("j", F.col("i") + F.col("expect") - F.col("p"))
    y = y.join(one, ["symbol", "i", "p"]).join(two, ["symbol", "j", "p"])
    hit = F.expr("case when dir = 1 then greatest(hi1, hi2) >= base * ratio * (1 - frac) else least(lo1, lo2) <= base * ratio * (1 + frac) end")
    r = y.groupBy("symbol", "cat", "name").agg((100.0 * F.avg(hit.cast("int"))).alias("rate"), F.count("*").alias("days"))
    return r.join(pool, "symbol").where((F.col("days") >= LEAST_DAYS) & (F.col("pool") >= LEAST_POOL)).select("symbol", "cat", "name", F.round("rate", 1).alias("rate"), "days")


_PRICED = f""", pt0 as (select d.symbol, d.cat, d.name, d.price, d.expect, greatest(10, d.expect)::double as h, td.* exclude (symbol) from dated d join td using (symbol)),
pt1 as (select *, {sql_interpolated('s', 'h')} as sigma, {sql_interpolated('m', 'h')} * drift as mu, {sql_interpolated('s', 'expect')} as s_exp, case when price >= close then 1 else -1 end as dir from pt0),
pt2 as (select *, {FRAC} as frac, least(s_exp * sqrt(expect) * scale, 0.235) as efrac from pt1), pt3 as (select *, price * (1 - dir * frac) as bar from pt2), pt as materialized (select *, {_PASS} as raw from pt3),
sd as materialized (select t.symbol, t.i, t.close as base from ts1 t join td using (symbol) where t.s20 >= {BAND[0]} * td.s20 and t.s20 <= {BAND[1]} * td.s20 and (t.close > t.ma) = td.above),
er0 as (select pt.symbol, cat, name, sd.i, max(b.high) as hi, min(b.low) as lo, any_value(base) as base, any_value(price / pt.close) as ratio, any_value(dir) as dir, any_value(efrac) as frac
  from pt join sd on sd.symbol = pt.symbol and sd.i + expect <= n join bars b on b.symbol = sd.symbol and b.i > sd.i and b.i <= sd.i + expect group by 1, 2, 3, 4),
er as (select symbol, cat, name, round(100.0 * avg((case when dir = 1 then hi >= base * ratio * (1 - frac) else lo <= base * ratio * (1 + frac) end)::int), 1) as rate, count(*) as days from er0 group by 1, 2, 3
  having count(*) >= {LEAST_DAYS} and (select count(*) from sd where sd.symbol = er0.symbol) >= {LEAST_POOL})"""

PRICED = TODAY + _PRICED


def whole(b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Targets with their prior, today, legs, rates of similar days."""
    z, now = kept(zigzag(b)), kept(today(b))
    x = kept(prior(priced(dated_targets(b, z), now)).withColumn("s_exp", sigma_of(F.col("expect").cast("double"))))
    return x, now, legs(z), kept(rates(x, b, similar_days(b, now)))


@query("empirical_target_rates", zsql(DATED + PRICED + " select * from er"))
def empirical_target_rates(spark, sf_dir):
    return whole(kept(bars(spark, sf_dir)))[3]


@query("target_priors", zsql(DATED + PRICED + " select symbol, cat, name, round(frac, 6) as frac, round(raw, 5) as raw from pt"))
def target_priors(spark, sf_dir):
    """First-passage chances of today's targets, before calibration."""
    b = bars(spark, sf_dir)
    x = prior(priced(dated_targets(b, zigzag(b)), today(b)))
    return x.select("symbol", "cat", "name", F.round("frac", 6).alias("frac"), F.round("raw", 5).alias("raw"))


# ---------------------------------------------------------------------------------------------- calibration of the prior
def prior_bins(b: DataFrame, now: DataFrame) -> DataFrame:
    """bin, n, v, iso per symbol: with today's drift and deviation the prior of a horizon, distance and direction is one number;
    its outcomes are those of every bar with 250 bars after it. Ten buckets, shrunk rates, made isotonic."""
    w = {h: by().rowsBetween(1, h) for h in GRID_HORIZONS}
    x = b.withColumns({f"hi{h}": F.max("high").over(w[h]) for h in GRID_HORIZONS} | {f"lo{h}": F.min("low").over(w[h]) for h in GRID_HORIZONS})
    x = x.join(now.drop("close"), "symbol").where(f"i >= 20 and i + {max(GRID_HORIZONS) + 1} <= n")
    grid = [(h, r, d) for h in GRID_HORIZONS for r in GRID_AMPLITUDES for d in (1, -1)]
    cell = lambda h, r, d: f"(1 + {d} * {r}D) * (1 - {d} * least({{s}} * sqrt({h}.0D) * scale, 0.235D))"
    at = {h: sigma_of(F.lit(float(h))) for h in GRID_HORIZONS}
    x = x.withColumns({f"v{h}": at[h] for h in GRID_HORIZONS} | {f"u{h}": drift_of(F.lit(float(h))) for h in GRID_HORIZONS})
    hit = lambda h, r, d: F.expr((f"hi{h} >= " if d == 1 else f"lo{h} <= ") + f"close * {cell(h, r, d).replace('{s}', f'v{h}')}")
    sums = x.groupBy("symbol").agg(F.count("*").alias("days"), *[F.count_if(hit(*g)).alias(f"c{k}") for k, g in enumerate(grid)], *[F.first(c).alias(c) for h in GRID_HORIZONS for c in (f"v{h}", f"u{h}")], F.first("scale").alias("scale"))
    rows = F.explode(F.array(*[F.struct(F.lit(float(h)).alias("h"), F.col(f"v{h}").alias("sigma"), F.col(f"u{h}").alias("mu"), F.lit(1.0).alias("close"), F.lit(d).alias("dir"), F.expr(cell(h, r, d).replace("{s}", f"v{h}")).alias("bar"), F.col(f"c{k}").alias("hits")) for k, (h, r, d) in enumerate(grid)])).alias("g")
    y = sums.select("symbol", "days", rows).select("symbol", "days", "g.*").withColumn("raw", F.round(F.expr(_PASS), 9))
    y = y.withColumn("bin", F.least(F.floor(F.col("raw") * 10), F.lit(9)).cast("int")).groupBy("symbol", "bin").agg(F.sum("days").alias("n"), F.sum("hits").alias("hits"))
    every = b.select("symbol").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    y = every.join(kept(y), ["symbol", "bin"], "left").select("symbol", "bin", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n"), F.expr("case when coalesce(n, 0) >= 40 then (hits + 2.5D) / (n + 5) else (bin + 0.5D) / 10 end").alias("v"))
    return isotonic_by(kept(y), ["symbol"])


def isotonic_by(bins: DataFrame, keys: list[str]) -> DataFrame:
    """pava() for several series at once; each has ten rows."""
    a, b = bins.select(*keys, F.col("bin").alias("a")), bins.select(*keys, F.col("bin").alias("b"))
    span = a.join(b, keys).where("a <= b").join(bins, keys).where("bin between a and b").groupBy(*keys, "a", "b").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("m"))
    low = span.join(bins.select(*keys, F.col("bin").alias("k")), keys).where("k between a and b").groupBy(*keys, "k", "a").agg(F.min("m").alias("m"))
    iso = low.groupBy(*keys, F.col("k").alias("bin")).agg(F.max("m").alias("iso"))
    return bins.join(iso, [*keys, "bin"])


_GRID = f"(select unnest({list(GRID_HORIZONS)})::int as hh), (select unnest({list(GRID_AMPLITUDES)})::double as r), (select unnest([1, -1]) as dir)"
BINS = f""", pg0 as (select td.* exclude (close), 1.0::double as close, hh, hh::double as h, r, dir from td, {_GRID}),
pg1 as (select *, {sql_interpolated('s', 'h')} as sigma, {sql_interpolated('m', 'h')} * drift as mu from pg0), pg2 as (select *, (1 + dir * r) * (1 - dir * least(sigma * sqrt(h) * scale, 0.235)) as bar from pg1),
pg as materialized (select symbol, hh, r, dir, n, bar, round({_PASS}, 9) as raw from pg2),
pw0 as (select symbol, i, close, {', '.join(f'max(high) over ({P} rows between 1 following and {h} following) as hi{h}, min(low) over ({P} rows between 1 following and {h} following) as lo{h}' for h in GRID_HORIZONS)} from bars),
pw1 as materialized (select symbol, i, hh, hi / close as hi, lo / close as lo from (""" + " union all ".join(f"select symbol, i, close, {h} as hh, hi{h} as hi, lo{h} as lo from pw0" for h in GRID_HORIZONS) + f""")),
pc as (select g.symbol, least(floor(g.raw * 10), 9)::int as bin, count(*) as n, count(*) filter (case when g.dir = 1 then w.hi >= g.bar else w.lo <= g.bar end) as hits from pg g join pw1 w on w.symbol = g.symbol and w.hh = g.hh and w.i >= 20 and w.i + {max(GRID_HORIZONS) + 1} <= g.n group by 1, 2),
pb as (select e.symbol, e.bin, greatest(coalesce(n, 0), 1) as n, case when coalesce(n, 0) >= 40 then (hits + 2.5) / (n + 5) else (e.bin + 0.5) / 10 end::double as v from (select distinct symbol, k::int as bin from bars, (select unnest(generate_series(0, 9)) as k)) e left join pc using (symbol, bin)),
ps as (select a.symbol, a.bin as a, b.bin as b, sum(c.n * c.v) / sum(c.n) as m from pb a join pb b on a.symbol = b.symbol and a.bin <= b.bin join pb c on c.symbol = a.symbol and c.bin between a.bin and b.bin group by 1, 2, 3),
pi_ as (select symbol, bin, max(m) as iso from (select i.symbol, i.bin, s.a, min(s.m) as m from pb i join ps s on s.symbol = i.symbol and i.bin between s.a and s.b group by 1, 2, 3) group by 1, 2)"""


@query("prior_calibration", zsql(TODAY + BINS + " select symbol, pb.bin, pb.n::bigint as n, round(v, 5) as v, round(iso, 5) as iso from pb join pi_ using (symbol, bin)"))
def prior_calibration(spark, sf_dir):
    b = bars(spark, sf_dir)
    return prior_bins(b, today(b)).select("symbol", "bin", "n", F.round("v", 5).alias("v"), F.round("iso", 5).alias("iso"))


# ----------------------------------------------------------------------------------------------------- reach of legs
#: Windows of time (times the horizon) in which a leg's time to reach the target counts, the narrow ones first.
REACH_WINDOWS = ((0.5, 2.0), (0.25, 4.0), (0.0, 1e9))


def reach_of_legs(x: DataFrame, l: DataFrame, least: int = 4) -> DataFrame:
    """symbol, cat, name, cap: of the legs in the target's direction whose time to cover its distance is near the horizon, the
    percentage that went that far; from the first window with four legs, from 2 to 98; no row where there is none."""
    t = x.select("symbol", "cat", "name", "dir", "h", F.ln(F.col("price") / F.col("close")).alias("need"))
    own = l.select(F.col("symbol").alias("ls"), "ret", "days")
    y = t.join(own, (F.col("symbol") == F.col("ls")) & (F.col("dir") * F.col("ret") > 0)).withColumn("ttr", F.col("days") * F.abs("need") / F.abs("ret"))
    wide = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(REACH_WINDOWS)])).alias("w")
    y = y.select("*", wide).where("ttr >= w.a * h and ttr <= w.b * h")
    y = y.groupBy("symbol", "cat", "name", "w.k").agg(F.count("*").alias("legs"), (100.0 * F.avg((F.abs("ret") >= F.abs("need")).cast("int"))).alias("cap")).where(F.col("legs") >= least)
    return y.groupBy("symbol", "cat", "name").agg(F.greatest(F.lit(2.0), F.least(F.lit(98.0), F.min_by("cap", "k"))).alias("cap"))


REACH = """, rl as (select pt.symbol, cat, name, dir, h, ln(pt.price / pt.close) as need, l.ret, l.days * abs(ln(pt.price / pt.close)) / abs(l.ret) as ttr from pt join legs l on l.symbol = pt.symbol and dir * l.ret > 0),
rk as (select symbol, cat, name, k, 100.0 * avg((abs(ret) >= abs(need))::int) as cap from rl, (select * from (values (0, 0.5, 2.0), (1, 0.25, 4.0), (2, 0.0, 1e9)) v(k, a, b)) where ttr >= a * h and ttr <= b * h group by 1, 2, 3, 4 having count(*) >= 4),
rc as (select symbol, cat, name, greatest(2.0, least(98.0, arg_min(cap, k))) as cap from rk group by 1, 2, 3)"""


@query("leg_reach", zsql(DATED + PRICED + REACH + " select symbol, cat, name, round(cap, 4) as cap from rc"))
def leg_reach(spark, sf_dir):
    x, _, l, _ = whole(kept(bars(spark, sf_dir)))
    return reach_of_legs(x, l).withColumn("cap", F.round("cap", 4))


# ------------------------------------------------------------------------------------------------------------ binder
#: The prior in percent, moved by the breadth of all symbols; then fused with the rate, or capped by the legs.
_PRIOR = "greatest(2e0, least(98e0, q * 100)) + breadth * dir * 5e0"
_PROB = f"round(greatest(2e0, least(98e0, case when rate is not null then (days * rate + {PRIOR_DAYS}e0 * prior) / (days + {PRIOR_DAYS}e0) when cap is not null and cap < prior then cap else prior end)), 1)"
_SOURCE = "case when rate is not null then 'history' when cap is not null and cap < prior then 'legs' else 'drift' end"
_Q = "case when raw >= 0.98e0 then raw else coalesce(iso, raw) end"


def bind(b: DataFrame) -> DataFrame:
    """symbol, cat, name, price, expect, close, lo, hi, band, prob, source of every dated target."""
    return published(kept(bound(b)))


def bound(b: DataFrame) -> DataFrame:
    """Every dated target with all that its probability is made of."""
    x, now, l, r = whole(b)
    bins = kept(prior_bins(b, now)).select("symbol", F.col("bin").alias("bin_"), "iso")
    x = x.withColumn("bin_", F.least(F.floor(F.col("raw") * 10), F.lit(9)).cast("int")).join(bins, ["symbol", "bin_"], "left")
    x = x.join(r, ["symbol", "cat", "name"], "left").join(reach_of_legs(x, l), ["symbol", "cat", "name"], "left").crossJoin(breadth(b, 5).select("breadth"))  # one row
    x = x.withColumn("q", F.expr(_Q)).withColumn("prior", F.expr(_PRIOR)).withColumns({"prob": F.expr(_PROB), "source": F.expr(_SOURCE)})
    return x


def published(x: DataFrame) -> DataFrame:
    return x.select("symbol", "cat", "name", "price", "expect", "close", F.expr("round(price * (1 - frac), 4)").alias("lo"), F.expr("round(price * (1 + frac), 4)").alias("hi"), F.expr("round(frac * 100, 4)").alias("band"), "prob", "source")


BOUND = DATED + PRICED + BINS + REACH + f""", br as (select sum(sign(r)) / 5.0 as breadth from (select symbol, arg_max(r, i) as r from (select symbol, i, close / lag(close, 20) over ({P}) - 1 as r from bars) group by 1)),
bn0 as (select pt.*, iso, rate, days, cap, breadth from pt left join pi_ on pi_.symbol = pt.symbol and pi_.bin = least(floor(raw * 10), 9)::int left join er on er.symbol = pt.symbol and er.cat = pt.cat and er.name = pt.name left join rc on rc.symbol = pt.symbol and rc.cat = pt.cat and rc.name = pt.name, br),
bn1 as (select *, {_Q} as q from bn0), bn2 as (select *, {_PRIOR} as prior from bn1),
bn as materialized (select symbol, cat, name, price, expect, close, round(price * (1 - frac), 4) as lo, round(price * (1 + frac), 4) as hi, round(frac * 100, 4) as band, {_PROB} as prob, {_SOURCE} as source from bn2)"""


@query("bound_targets", zsql(BOUND + " select * from bn"))
def bound_targets(spark, sf_dir):
    """The published table of targets: band and probability, and which of the three sources gave it."""
    return bind(kept(bars(spark, sf_dir)))


@query("probability_sources", zsql(BOUND + " select cat, source, count(*) as n, round(avg(prob), 4) as prob from bn group by grouping sets ((cat, source), (source))"))
def probability_sources(spark, sf_dir):
    return bind(kept(bars(spark, sf_dir))).groupingSets([["cat", "source"], ["source"]], "cat", "source").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 4).alias("prob"))


# ------------------------------------------------------------------------------------------------------------- gates
#: What a published target must keep to. Every third one is spoilt on purpose, so that the gate has something to find.
LOCK = {"probability": "prob < 2 or prob > 98", "band": "band <= 0 or band > 23.5", "order": "lo > price or hi < price", "width": "abs((hi - lo) / 2 / price * 100 - band) > 0.01", "time": "expect < 1 or expect > 330"}
_SPOIL = {"prob": "case when k % 3 = 0 then prob + 100 else prob end", "lo": "case when k % 3 = 1 and cat = 'part' then price * 2 else lo end"}


def lock(published: DataFrame) -> DataFrame:
    """check, n, violations of a published table: a row for every check, also where nothing is published."""
    counts = published.agg(F.count("*").alias("n"), *[F.count_if(F.expr(e)).alias(f"bad_{n}") for n, e in LOCK.items()])  # one row
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), "n", F.col(f"bad_{n}").alias("violations")) for n in LOCK])).alias("c")
    return counts.select(one).select("c.*")


_LOCKSQL = " union all ".join(f"select '{n}' as \"check\", count(*) as n, count(*) filter ({e}) as violations from {{t}}" for n, e in LOCK.items())


@query("gate_probability_lock", zsql(BOUND + " " + _LOCKSQL.replace("{t}", "bn")))
def gate_probability_lock(spark, sf_dir):
    return lock(bind(kept(bars(spark, sf_dir))))


@query("gate_probability_lock_spoilt", zsql(BOUND + ", sp as (select * replace (" + ", ".join(f"{e} as {c}" for c, e in _SPOIL.items()) + ") from (select *, row_number() over (partition by symbol, cat order by name) as k from bn)) " + _LOCKSQL.replace("{t}", "sp")))
def gate_probability_lock_spoilt(spark, sf_dir):
    """The lock over a table with wrong rows: it has to find them."""
    x = bind(kept(bars(spark, sf_dir))).withColumn("k", F.row_number().over(Window.partitionBy("symbol", "cat").orderBy("name")))
    return lock(x.withColumns({c: F.expr(e) for c, e in _SPOIL.items()}))


@query("gate_parts_end", zsql(BOUND + " select p.symbol, abs(p.price - s.price) <= 0.0002 as locked, s.expect >= p.expect as in_time, (select bool_and(q.expect >= coalesce(l, 0)) from (select expect, lag(expect) over (partition by symbol order by name) as l, symbol from bn where cat = 'part') q where q.symbol = p.symbol) as in_order from bn p join bn s on s.symbol = p.symbol and s.name = 'sell 1' where p.name = 'part 5'"))
def gate_parts_end(spark, sf_dir):
    """The last part of wave 5 ends at the first sell target, not after its time, and the parts' times do not go back."""
    x = bind(kept(bars(spark, sf_dir)))
    s = x.where("name = 'sell 1'").select("symbol", F.col("price").alias("sp"), F.col("expect").alias("se"))
    up = x.where("cat = 'part'").withColumn("l", F.lag("expect").over(Window.partitionBy("symbol").orderBy("name"))).groupBy("symbol").agg(F.every(F.col("expect") >= F.coalesce("l", F.lit(0))).alias("in_order"))
    return x.where("name = 'part 5'").join(s, "symbol").join(up, "symbol").select("symbol", (F.abs(F.col("price") - F.col("sp")) <= 0.0002).alias("locked"), (F.col("se") >= F.col("expect")).alias("in_time"), "in_order")


# ------------------------------------------------------------------------------------------------------------ overlay
def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rates by key: those of new where it has them, else those of old; keys of either side."""
    n = new.withColumnsRenamed({"rate": "rate_", "days": "days_"})
    return old.join(n, keys, "full").select(*keys, F.coalesce("rate_", "rate").alias("rate"), F.coalesce("days_", "days").alias("days"), F.when(F.col("rate_").isNotNull(), "history").otherwise("log").alias("source"))


@query("hit_rate_overlay", EVAL + TODAY + ", dated as (select symbol, 'log' as cat, case when m > 0 then 'up' else 'down' end || abs(m)::varchar as name, close * (1 + m / 100.0::double) as price, e::int as expect from td, (select * from (values " + ", ".join(str(x) for x in TARGETS[:-1]) + ") v(m, e)))" + _PRICED + """,
  ol as (select key, round(100.0 * (count(*) filter (state = 'hit') + 1) / (count(*) + 2), 4) as rate, count(*) as days from ev2 where state <> 'pending' group by 1), nw as (select name as key, round(sum(rate * days) / sum(days), 4) as rate, sum(days)::bigint as days from er group by 1)
  select key, coalesce(nw.rate, ol.rate) as rate, coalesce(nw.days, ol.days) as days, case when nw.rate is not null then 'history' else 'log' end as source from ol full join nw using (key)""", bars=True)
def hit_rate_overlay(spark, sf_dir):
    """Back-test rates of the written log, overlaid by the rates that similar days give the same distances and horizons."""
    return hit_rates(kept(bars(spark, sf_dir)))


def hit_rates(b: DataFrame) -> DataFrame:
    h = F.count_if(F.col("state") == "hit")
    old = evaluate(banded(target_log(b), b), b).where("state <> 'pending'").groupBy("key").agg(F.round(100.0 * (h + 1) / (F.count("*") + 2), 4).alias("rate"), F.count("*").alias("days"))
    now = today(b)
    t = now.select("symbol", F.explode(F.array(*[F.struct(F.lit(("up" if m > 0 else "down") + str(abs(m))).alias("name"), F.lit(1 + m / 100).alias("f"), F.lit(e).alias("expect")) for m, e in TARGETS[:-1]])).alias("x"), "close").select("symbol", F.lit("log").alias("cat"), "x.name", (F.col("close") * F.col("x.f")).alias("price"), "x.expect")
    x = prior(priced(t, now)).withColumn("s_exp", sigma_of(F.col("expect").cast("double")))
    new = rates(x, b, similar_days(b, now)).groupBy(F.col("name").alias("key")).agg(F.round(F.sum(F.col("rate") * F.col("days")) / F.sum("days"), 4).alias("rate"), F.sum("days").alias("days"))
    return overlay(old, new, ["key"])
