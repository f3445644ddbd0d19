"""Constraints on published targets: every rule finds the rows that were spoilt for it, and no others."""

import math

import pytest
from pyspark.sql import functions as F

from barwright.operators.binding import bound, published
from barwright.operators.constraints import KEYS, RULES, SPOILS, checked, confronted, derived, normal, spoilt, violations
from barwright.sources.bars import bars
from barwright.sources.shared import kept


@pytest.fixture(scope="module")
def facts(spark, sf):
    return kept(bound(kept(bars(spark, sf))))


def broken(f):
    return {(r.symbol, r.cat, r["name"], r.rule) for r in f.collect()}


@pytest.fixture(scope="module")
def natural(facts):
    """A plan may have a later sell below an earlier one; nothing else is broken as published."""
    found = broken(violations(published(facts), facts))
    assert {rule for *_, rule in found} <= {"rising sells"}
    return found


#: The rules that each spoil breaks, in its own row.
BREAKS = {1: {"probability"}, 2: {"word", "source"}, 3: {"inside", "edges"}, 4: {"band"}, 5: {"days"}, 6: {"fields"}, 7: {"price"}, 8: {"planned", "published"}}


def test_each_spoil_is_found_and_only_that(facts, natural):
    rows = sorted((r.symbol, r.cat, r["name"]) for r in facts.collect())
    want, names = set(), {}
    for s, c, n in rows:
        k = names[s] = names.get(s, 0) + 1
        for rule in BREAKS.get(k, ()):
            want.add((s, c, n + "?" if rule == "planned" else n, rule))
    assert max(names.values()) >= len(SPOILS)
    own = {"rising sells", "parts in time"}  # these follow from spoilt neighbours
    assert {x for x in broken(violations(spoilt(published(facts)), facts)) if x[3] not in own} == want


def test_order_of_prices_and_times(spark, facts, natural):
    out = published(facts)
    sells = out.where("cat = 'sell'").orderBy(*KEYS).first()
    bad = out.withColumn("price", F.when((F.col("symbol") == sells.symbol) & (F.col("name") == "sell 3"), F.lit(0.01)).otherwise(F.col("price")))
    assert (sells.symbol, "sell", "sell 3", "rising sells") in broken(violations(bad, facts))
    late = out.withColumn("expect", F.when((F.col("symbol") == sells.symbol) & (F.col("cat") == "part"), 300 - F.length("name") - F.ascii(F.substring("name", -1, 1))).otherwise(F.col("expect")))
    assert any(rule == "parts in time" and s == sells.symbol for s, *_, rule in broken(violations(late, facts)))


def test_expected_and_found(facts, natural):
    row = facts.orderBy(*KEYS).first()
    got = {r.rule: r for r in violations(spoilt(published(facts)), facts).where((F.col("symbol") == row.symbol) & (F.col("name") == row["name"])).collect()}
    assert abs(float(got["probability"].expected) - row.prob) < 0.65 and abs(float(got["probability"].found) - row.prob) == pytest.approx(9)


def test_normal(spark):
    xs = [-9.0, -3.1, -1.0, -0.2, 0.0, 0.5, 1.96, 4.0, 20.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal(F.col("x")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-10) for r in got)


def test_derived_by_hand(spark):
    """A target 10 percent up, the band 5 percent, no drift: twice the chance to end beyond its near edge (reflection)."""
    cols = "symbol string, price double, close double, dir int, frac double, mu double, sigma double, h double, iso double, rate double, days long, cap double, breadth double"
    base = dict(symbol="a", price=110.0, close=100.0, dir=1, frac=0.05, mu=0.0, sigma=0.01, h=25.0, iso=None, rate=None, days=None, cap=None, breadth=0.0)
    cases = [base, base | dict(breadth=0.4), base | dict(cap=10.0), base | dict(iso=0.3), base | dict(rate=50.0, days=20), base | dict(frac=0.1), base | dict(price=90.0, dir=-1)]
    got = [(r.derived, r.binder) for r in derived(spark.createDataFrame([tuple(c.values()) for c in cases], cols)).select("derived", "binder").collect()]
    p = 100 * math.erfc(math.log(1.045) / (0.01 * 5) / math.sqrt(2))
    down = 100 * math.erfc(-math.log(0.945) / (0.01 * 5) / math.sqrt(2))
    want = [(p, "drift"), (p + 2, "drift"), (10.0, "legs"), (30.0, "drift"), ((20 * 50 + 20 * p) / 40, "history"), (98.0, "drift"), (down, "drift")]
    assert [b for _, b in got] == [b for _, b in want]
    assert [v for v, _ in got] == pytest.approx([v for v, _ in want], abs=1e-6)


def test_empty(spark, facts):
    none = published(facts).limit(0)
    assert broken(violations(none, facts.limit(0))) == set()
    assert {rule for *_, rule in broken(violations(none, facts))} == {"published"}
    assert set(RULES) >= {r.rule for r in checked(confronted(none, facts)).select("rule").distinct().collect()}
