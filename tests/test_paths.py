"""Chances of the three paths: every step alone, with the value worked out by hand."""

import pytest
from pyspark.sql import functions as F

from barwright.operators.paths import STEPS, TEMPLATES, chances, fits, template_points

SCHEMA = """id string, scenario string, side int, past_n double, past_main double, past_alt double, past_risk double, point_n long, point_win double, confidence int, level string, fits boolean, slowing boolean,
nesting string, month_polarity int, trend_turns long, range_turns long, turns long, least_ratio double, mid_volume double, bias double, score double"""
NAMES = [c.split()[0] for c in SCHEMA.split(",")]

# facts beside the neutral ones, then main, alt, risk
CASES = {
    "rising": (dict(), (0.58, 0.23, 0.19)),  # 0.42 * 0.55 = 0.231
    "pause": (dict(scenario="pause below the high"), (0.5, 0.27, 0.23)),
    "falling": (dict(scenario="falling", side=-1), (0.34, 0.36, 0.3)),
    "other": (dict(scenario="no zone, up", side=0), (0.45, 0.3, 0.25)),
    "confident": (dict(confidence=70), (0.64, 0.2, 0.16)),
    "to be confirmed": (dict(level="to be confirmed"), (0.54, 0.25, 0.21)),
    "borderline": (dict(level="borderline"), (0.56, 0.24, 0.2)),
    "fit": (dict(fits=True), (0.6, 0.22, 0.18)),
    "slowing": (dict(fits=True, slowing=True), (0.58, 0.23, 0.19)),
    "nesting": (dict(nesting="bottom within a falling week"), (0.61, 0.21, 0.18)),
    "month with": (dict(month_polarity=1), (0.6, 0.22, 0.18)),
    "month against": (dict(month_polarity=-1), (0.56, 0.24, 0.2)),
    "bear month": (dict(scenario="falling", side=-1, month_polarity=-1), (0.36, 0.35, 0.29)),
    "trend turn": (dict(turns=2, trend_turns=1, range_turns=1), (0.61, 0.21, 0.18)),
    "range turns": (dict(turns=2, trend_turns=0, range_turns=2), (0.56, 0.24, 0.2)),
    "mixed turns": (dict(turns=2, trend_turns=0, range_turns=1), (0.58, 0.23, 0.19)),
    "bear trend turn": (dict(scenario="falling", side=-1, turns=1, trend_turns=1, range_turns=0), (0.31, 0.38, 0.31)),
    "strong": (dict(least_ratio=0.65), (0.59, 0.23, 0.18)),
    "feeble": (dict(least_ratio=0.92), (0.57, 0.24, 0.19)),
    "less volume": (dict(mid_volume=0.84), (0.59, 0.23, 0.18)),
    "more volume": (dict(mid_volume=1.16), (0.57, 0.24, 0.19)),
    "far above": (dict(bias=0.07), (0.55, 0.25, 0.2)),
    "far below": (dict(bias=-0.07), (0.61, 0.21, 0.18)),
    "bear far above": (dict(scenario="falling", side=-1, bias=0.07), (0.37, 0.35, 0.28)),
    # 20 outcomes count 20 / 32; 0.58 * 0.375 + (0.5 + 0.2 * 0.7) * 0.625 = 0.6175
    "points": (dict(point_n=20, point_win=0.7), (0.62, 0.21, 0.17)),
    "few points": (dict(point_n=4, point_win=0.9), (0.58, 0.23, 0.19)),
    # 12 samples count 0.5 * 1.6 = 0.8: 0.58 * 0.2 + 0.3 * 0.8 = 0.356, and share 0.55 * 0.2 + 0.5 / 0.7 * 0.8 = 0.681
    "past": (dict(past_n=12.0, past_main=0.3, past_alt=0.5, past_risk=0.2, point_n=20, point_win=0.7), (0.36, 0.44, 0.2)),
    # 36 samples count at most 0.85; 0.087 + 0.17 = 0.257, but no less than 0.3; share 0.0825 + 0.25 / 0.8 * 0.85 = 0.348
    "past, floor": (dict(past_n=36.0, past_main=0.2, past_alt=0.25, past_risk=0.55), (0.3, 0.24, 0.46)),
    # 0.58 * 0.2 + 0.4 * 0.8 = 0.436 and 0.15 of confidence = 0.586, at most 0.42 + 0.4 * 0.42 = 0.588; fit brings 0.606
    "past, cap": (dict(past_n=12.0, past_main=0.4, past_alt=0.3, past_risk=0.3, confidence=100, fits=True), (0.59, 0.21, 0.2)),
    "past of no side": (dict(scenario="no zone, up", side=0, past_n=12.0, past_main=0.9, past_alt=0.1, past_risk=0.0), (0.45, 0.3, 0.25)),
    # all other paths end on alt: share 0.55 * 0.2 + 0.8 = 0.91, 0.28 * 0.91 = 0.25, risk is lifted from 0.03
    "least risk": (dict(past_n=12.0, past_main=0.9, past_alt=0.1, past_risk=0.0), (0.72, 0.23, 0.05)),
    "breadth against": (dict(score=-0.2), (0.5, 0.27, 0.23)),
    "breadth with": (dict(score=0.9), (0.58, 0.23, 0.19)),
    "bear breadth against": (dict(scenario="falling", side=-1, confidence=100, nesting="top", score=0.2), (0.5, 0.27, 0.23)),
    "bounds above": (dict(confidence=100), (0.72, 0.15, 0.13)),
    "bounds below": (dict(scenario="falling", side=-1, confidence=0), (0.3, 0.39, 0.31)),
    "nulls": (dict(scenario=None, side=None, confidence=None, fits=None, slowing=None, nesting=None, month_polarity=None, level=None), (0.45, 0.3, 0.25)),
}
NEUTRAL = dict(scenario="rising", side=1, confidence=50, level="firm", fits=False, slowing=False, nesting="none", month_polarity=0, score=0.0)


@pytest.fixture(scope="module")
def found(spark):
    rows = [tuple({**NEUTRAL, **facts, "id": name}.get(c) for c in NAMES) for name, (facts, _) in CASES.items()]
    return {r["id"]: r for r in chances(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("name", CASES)
def test_step_alone(found, name):
    row, (main, alt, risk) = found[name], CASES[name][1]
    assert row["main"] == pytest.approx(main, abs=1e-9)
    assert row["main"] + row["alt"] + row["risk"] == pytest.approx(1, abs=1e-9)
    assert (row["alt"], row["risk"]) == (pytest.approx(alt, abs=0.0101), pytest.approx(risk, abs=0.0101)) and row["risk"] >= 0.05


def test_steps_are_recorded(found):
    assert found["confident"]["p_history"] == 0.58 and found["confident"]["p_confidence"] == pytest.approx(0.64)
    assert {f"p_{n}" for n, _ in STEPS} <= set(found["confident"].asDict())


def test_templates(spark):
    x = spark.createDataFrame([("a", "rising", 100.0, 90.0, 80.0, 0.05), ("b", "falling", 70.0, 90.0, 80.0, 0.05), ("c", "no zone, up", 100.0, None, None, None)], "symbol string, scenario string, close double, zg double, zd double, move double")
    got = {(r.symbol, r.path, r.t): r.v for r in template_points(x).collect()}
    assert got["a", "main", 55] == pytest.approx(105.0) and got["a", "main", 100] == pytest.approx(108.15)  # the goal: 5 percent on, above the zone
    assert got["a", "alt", 100] == pytest.approx(89.1) and got["a", "risk", 100] == pytest.approx(75.2)
    assert got["b", "main", 20] == 90 and got["b", "main", 100] == pytest.approx(84.15) and got["b", "risk", 0] == 70
    assert got["c", "main", 25] == pytest.approx(100.0) and got["c", "alt", 30] == pytest.approx(105 * 0.99)
    assert all(at[-1][0] == 100 and all(f % 5 == 0 for f, _, _ in at) for g in TEMPLATES.values() for at in g.values())


def test_fits(spark):
    """A straight log line fits wholly; a bend that slows is slower in the second half; few bars fit nothing."""
    rows = [("line", i, 100 * 1.01**i) for i in range(130)] + [("bend", i, 100 * 1.01 ** (i if i < 100 else 100 + (i - 100) * 0.3)) for i in range(130)] + [("few", i, 100.0 + i) for i in range(9)]
    b = spark.createDataFrame(rows, "symbol string, i int, close double")
    h = b.select("symbol").distinct().withColumn("horizon", F.lit(60))
    got = {r.symbol: r for r in fits(b, h).collect()}
    assert got["line"].r2 == pytest.approx(1) and got["line"].ahead == pytest.approx(1.01**60) and got["line"].one_way and not got["line"].slowing
    assert got["bend"].one_way and got["bend"].slowing
    assert got["few"].ahead is None and not got["few"].one_way and not got["few"].slowing
