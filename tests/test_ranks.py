"""Expanding ranks by halves against the plain definition."""

import random

from barwright.operators.indicators import expanding_rank


def test_expanding_rank(spark):
    """Ties, nulls, values that are no numbers, one bar, falling and rising series."""
    draw = random.Random(7)
    series = {"mixed": [draw.choice([None, float("nan"), *[draw.randint(0, 9) / 4 for _ in range(8)]]) for _ in range(203)], "one": [1.0], "none": [None, None], "up": [float(k) for k in range(64)], "down": [float(-k) for k in range(65)], "same": [2.0] * 17}
    got = {(r.symbol, r.i): r.p for r in expanding_rank(spark.createDataFrame([(s, k, v) for s, x in series.items() for k, v in enumerate(x)], "symbol string, i int, x double"), "x", "p").collect()}
    assert len(got) == sum(map(len, series.values()))
    for s, x in series.items():
        for k, v in enumerate(x):
            seen = [u for u in x[: k + 1] if u is not None and u == u]
            want = None if v is None or v != v else 100.0 * sum(u < v for u in seen) / len(seen)
            assert got[s, k] == want, (s, k)


def test_no_python_worker(spark):
    b = spark.range(10).selectExpr("'a' as symbol", "cast(id as int) as i", "rand(1) as x")
    plan = expanding_rank(b, "x", "p")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
