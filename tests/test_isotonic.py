"""Isotonic regression in parts against plain pooling."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barwright.functions.isotonic import looked_up, pools
from barwright.operators import probability, reports
from barwright.sources.bars import bars


def plainly(samples):
    """Pools (lo, hi, n, mean) of samples (x, y); equal x first have one mean."""
    by = {}
    for x, y in samples:
        by.setdefault(x, []).append(y)
    stack = []
    for x in sorted(by):
        stack.append([x, x, len(by[x]), sum(by[x])])
        while len(stack) > 1 and stack[-1][3] / stack[-1][2] < stack[-2][3] / stack[-2][2] - 1e-12:
            _, hi, n, s = stack.pop()
            stack[-1] = [stack[-1][0], hi, stack[-1][2] + n, stack[-1][3] + s]
    return [(lo, hi, n, s / n) for lo, hi, n, s in stack]


def step(steps, x):
    if x <= steps[0][0]:
        return steps[0][3]
    if x >= steps[-1][1]:
        return steps[-1][3]
    return next((v for lo, hi, _, v in steps if lo <= x <= hi), x)


@pytest.mark.parametrize("shape", ["rising", "falling", "noise"])
def test_ten_thousand_samples_with_ties(spark, shape):
    rng, rows = random.Random(3), []
    for i in range(10_000):
        x = rng.randrange(700) / 700
        p = {"rising": x, "falling": 1 - x, "noise": 0.5}[shape]
        rows.append(("a" if i % 3 else "b", x, float(rng.random() < p)))
    rows += [("a", None, 1.0), ("b", 0.5, None), ("one", 0.25, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, x double, y double")
    got = sorted((r.symbol, r.no, r.lo, r.hi, r.n, r.value) for r in pools(df, F.col("x"), F.col("y")).collect())
    want = []
    for s in ("a", "b", "one"):
        want += [(s, k, *p) for k, p in enumerate(plainly([r[1:] for r in rows if r[0] == s and None not in r]))]
    assert len(got) == len(want)
    assert all(a[:5] == b[:5] and math.isclose(a[5], b[5], abs_tol=1e-12) for a, b in zip(got, want))


def test_step_look_up(spark):
    steps = spark.createDataFrame([("a", 1.0, 2.0, 0.1), ("a", 3.0, 3.0, 0.4), ("a", 5.0, 8.0, 0.9)], "symbol string, lo double, hi double, value double")
    rows = spark.createDataFrame([("a", x, "kept") for x in (0.0, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0, 8.0, 9.0)], "symbol string, x double, extra string")
    got = {r.x: r.v for r in looked_up(rows, "x", steps, "v").collect()}
    want = [(1.0, 2.0, 1, 0.1), (3.0, 3.0, 1, 0.4), (5.0, 8.0, 1, 0.9)]
    assert got == {x: step(want, x) for x in got} and len(got) == 10


def test_time_calibration_plainly(spark, sf):
    x = reports.time_records(bars(spark, sf)).collect()
    got = {r.symbol: r for r in reports.time_calibration(spark, sf).collect()}
    assert got
    for s in {r.symbol for r in x}:
        own = sorted((r.i, r.r, r.pred, r.days) for r in x if r.symbol == s)
        cut = int(len(own) * 0.6)
        steps, rest = plainly([o[2:] for o in own[:cut]]), own[cut:]
        error = lambda f: sum(abs(f(p) - d) / d for _, _, p, d in rest) / len(rest)
        assert abs(got[s].before - error(lambda p: p)) < 1e-4 and abs(got[s].after - error(lambda p: step(steps, p))) < 1e-4
        assert got[s].n == len(rest) and got[s].steps == len(steps)


def test_isotonic_samples_plainly(spark, sf):
    x = probability.calibration_samples(bars(spark, sf)).selectExpr("symbol", "cast(floor(p * 10000 + 0.001) as int) as x", "cast(y as double) as y").toPandas()
    got = sorted(tuple(r) for r in probability.isotonic_samples(spark, sf).collect())
    want = [(s, k, lo, hi, n, round(v, 6)) for s, own in x.groupby("symbol") for k, (lo, hi, n, v) in enumerate(plainly(zip(own.x, own.y)))]
    assert len(got) == len(want) and all(a[:5] == b[:5] and abs(a[5] - b[5]) < 2e-6 for a, b in zip(got, sorted(want)))
