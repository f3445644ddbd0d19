"""Published targets against what they were made of: declared constraints, each of which gives the rows that break it with the
value expected and the value found. Probabilities are derived again from their parts, by another form of the normal
distribution (Simpson's rule) than the one that made them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.bars import bars
from ..sources.shared import kept
from .binding import BOUND, bound, published
from .waves import zsql

KEYS = ["symbol", "cat", "name"]
#: Targets that history speaks for may differ by rounding of its rate; the others only by rounding of the probability.
NEAR_HISTORY, NEAR = 0.6, 0.15
SIMPSON = 200


class Rule(NamedTuple):
    """when: rows it is about; expected and found as strings; holds: null counts as broken."""

    when: str
    expected: str
    found: str
    holds: str


RULES = {
    "planned": Rule("true", "'a planned target'", "case when planned is null then 'none' else 'a planned target' end", "planned is not null"),
    "published": Rule("planned is not null", "'published'", "case when price is null then 'missing' else 'published' end", "price is not null"),
    "price": Rule("price is not null and planned is not null", "cast(round(f_price, 4) as string)", "cast(price as string)", "abs(price - f_price) <= 1e-4"),
    "fields": Rule("price is not null", "'no null'", "concat_ws(',', case when lo is null then 'lo' end, case when hi is null then 'hi' end, case when band is null then 'band' end, case when prob is null then 'prob' end, case when source is null then 'source' end, case when expect is null then 'expect' end)", "lo is not null and hi is not null and band is not null and prob is not null and source is not null and expect is not null"),
    "inside": Rule("lo is not null and hi is not null and price is not null", "concat('between ', lo, ' and ', hi)", "cast(price as string)", "lo < price and price < hi"),
    "edges": Rule("lo is not null and hi is not null and f_frac is not null", "concat(round(f_price * (1 - f_frac), 4), ' to ', round(f_price * (1 + f_frac), 4))", "concat(lo, ' to ', hi)", "abs(lo - f_price * (1 - f_frac)) <= 1e-3 and abs(hi - f_price * (1 + f_frac)) <= 1e-3"),
    "band": Rule("band is not null", "'above 0, below 25'", "cast(band as string)", "band > 0 and band < 25"),
    "range": Rule("prob is not null", "'2 to 98'", "cast(prob as string)", "prob between 2 and 98"),
    "days": Rule("expect is not null", "'1 to 330'", "cast(expect as string)", "expect between 1 and 330"),
    "word": Rule("source is not null", "'history, legs or drift'", "source", "source in ('history', 'legs', 'drift')"),
    "source": Rule("source is not null and planned is not null", "binder", "source", "source = binder"),
    "probability": Rule("prob is not null and planned is not null", "cast(round(derived, 1) as string)", "cast(prob as string)", f"abs(prob - derived) < case when f_rate is not null then {NEAR_HISTORY} else {NEAR} end"),
    "rising sells": Rule("cat = 'sell' and before is not null", "concat('above ', before)", "cast(price as string)", "price > before"),
    "parts in time": Rule("cat = 'part' and time_before is not null", "concat('at least ', time_before)", "cast(expect as string)", "expect >= time_before"),
}


def normal(x):
    """Normal distribution function of a column by Simpson's rule from 0, exact to ten places; beyond 8 deviations 0 or 1."""
    z = F.least(F.abs(x), F.lit(8.0))
    step = z / SIMPSON
    weight = lambda k: F.when((k == 0) | (k == SIMPSON), 1).when(k % 2 == 1, 4).otherwise(2)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(SIMPSON)), F.lit(0.0), lambda s, k: s + weight(k) * F.exp(-0.5 * F.pow(k * step, F.lit(2.0)))) * step / 3 / (2 * 3.141592653589793) ** 0.5
    return F.when(x >= 0, 0.5 + area).otherwise(0.5 - area)


def derived(facts: DataFrame) -> DataFrame:
    """Adds derived (the probability in percent) and binder (the source) from rate, days, cap, iso, breadth, and from sigma, mu, h,
    price, close and frac: the chance that a walk with drift comes within the band of the price."""
    c = F.col
    far = F.abs(F.ln(c("price") * (1 - c("dir") * c("frac")) / c("close")))  # to the near edge of the band
    there = (c("price") * (1 - c("dir") * c("frac")) - c("close")) * c("dir") <= 0
    pull, spread = c("mu") * c("dir"), c("sigma") * F.sqrt("h")
    beyond = normal((pull * c("h") - far) / spread)
    back = F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), 2 * pull * far / (c("sigma") * c("sigma") + 1e-12)))) * normal((-pull * c("h") - far) / spread)
    raw = F.when(there, 1.0).otherwise(beyond + back)
    x = facts.withColumn("chance", raw)
    x = x.withColumn("chance", F.when(c("chance") >= 0.98, c("chance")).otherwise(F.coalesce("iso", "chance")))
    x = x.withColumn("drifted", F.greatest(F.lit(2.0), F.least(F.lit(98.0), c("chance") * 100)) + 5 * c("breadth") * c("dir"))
    capped = c("cap").isNotNull() & (c("cap") < c("drifted"))
    value = F.when(c("rate").isNotNull(), (c("days") * c("rate") + 20 * c("drifted")) / (c("days") + 20)).when(capped, c("cap")).otherwise(c("drifted"))
    return x.withColumns({"derived": F.greatest(F.lit(2.0), F.least(F.lit(98.0), value)), "binder": F.when(c("rate").isNotNull(), "history").when(capped, "legs").otherwise("drift")})


def confronted(out: DataFrame, facts: DataFrame) -> DataFrame:
    """Published rows beside the facts of the same target (f_*); rows of either side that the other lacks stay."""
    f = derived(facts).select(*KEYS, F.lit(True).alias("planned"), F.col("price").alias("f_price"), F.col("frac").alias("f_frac"), F.col("rate").alias("f_rate"), "derived", "binder")
    w = Window.partitionBy("symbol", "cat").orderBy("name")
    return out.join(f, KEYS, "full").withColumns({"before": F.lag("price").over(w), "time_before": F.lag("expect").over(w)})


def checked(x: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """symbol, cat, name, rule, expected, found, broken: one row for each target and rule that is about it. One pass, no join."""
    one = [F.when(F.expr(r.when), F.struct(F.lit(n).alias("rule"), F.expr(r.expected).alias("expected"), F.expr(r.found).alias("found"), F.expr(f"not coalesce({r.holds}, false)").alias("broken"))) for n, r in rules.items()]
    return x.select(*KEYS, F.explode(F.array_compact(F.array(*one))).alias("r")).select(*KEYS, "r.*")


def violations(out: DataFrame, facts: DataFrame) -> DataFrame:
    """symbol, cat, name, rule, expected, found of every rule that is broken."""
    return checked(confronted(out, facts)).where("broken").drop("broken")


_CLEAN = {"rising sells": "cat = 'sell' and before is not null", "parts in time": "cat = 'part' and before is not null"}
_BROKEN = {"rising sells": "count(*) filter (price <= before)"}


@query("gate_constraints", zsql(BOUND + ", cb as (select *, lag(price) over (partition by symbol, cat order by name) as before from bn) " + " union all ".join(f"select '{n}' as rule, count(*) as n, {_BROKEN.get(n, '0::bigint')} as broken from cb where {_CLEAN.get(n, 'true')} having count(*) > 0" for n in RULES)))
def gate_constraints(spark, sf_dir):
    """How many rows each constraint is about and how many break it, over the published table. None may, but for the sells of a plan
    whose third wave is so long that its later target lies below the one before: these are found in the plan itself."""
    x = kept(bound(kept(bars(spark, sf_dir))))
    return checked(confronted(published(x), x)).groupBy("rule").agg(F.count("*").alias("n"), F.count_if("broken").alias("broken"))


#: What is done to the k-th row of a symbol: the column and what it becomes.
SPOILS = {1: ("prob", "case when prob > 50 then prob - 9 else prob + 9 end"), 2: ("source", "'guess'"), 3: ("lo", "price * 2"), 4: ("band", "30"), 5: ("expect", "400"), 6: ("hi", "null"), 7: ("price", "price * 1.001"), 8: ("name", "concat(name, '?')")}


def spoilt(out: DataFrame) -> DataFrame:
    """A published table with one wrong value in each of the first rows of a symbol."""
    x = out.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("cat", "name")))
    change = lambda c: F.expr("case k " + " ".join(f"when {k} then {e}" for k, (of, e) in SPOILS.items() if of == c) + f" else {c} end").alias(c)
    return x.select(*[change(c) if any(of == c for of, _ in SPOILS.values()) else c for c in out.columns])


@query("gate_constraints_spoilt")
def gate_constraints_spoilt(spark, sf_dir):
    """The rows that break a constraint in a table with wrong values, with what was expected; a test names them one by one."""
    x = kept(bound(kept(bars(spark, sf_dir))))
    return violations(spoilt(published(x)), x)
