"""Queries that take all rows, against plain restatements over all rows."""

import math
import random
from datetime import timedelta

import numpy as np
import pytest

from barwright.operators import probability, sentiment
from barwright.plans.catalogue import ORACLES, QUERIES
from barwright.sources.bars import bars

from test_queries import canon, duck  # noqa: F401

H, R = (20, 40, 60, 90, 120, 180, 250), (0.03, 0.05, 0.08, 0.12, 0.15, 0.20)


def close_to(a, b, tol=2e-5):
    return len(a) == len(b) and all(abs(p - q) <= tol * max(1, abs(q)) if isinstance(p, float) and isinstance(q, float) else p == q for x, y in zip(a, b) for p, q in zip(x, y))


def samples_by_hand(bars):
    """The walk-forward loop over anchors, horizons, amplitudes and directions."""
    cdf = lambda x: 0.5 * (1 + math.erf(x / 2**0.5))
    close, high, low = zip(*bars)
    ret = [None] + [math.log(b / a) for a, b in zip(close, close[1:])]

    def moments(i, w):
        if i < w:
            return None
        x = ret[i - w + 1 : i + 1]
        m = sum(x) / w
        return (sum((v - m) ** 2 for v in x) / (w - 1)) ** 0.5, m

    def at(i, h):
        ws = (20, 60, 120, 250)
        if h in ws:
            return moments(i, h)
        a, b = next((a, b) for a, b in zip(ws, ws[1:]) if a < h < b)
        p, q, t = moments(i, a), moments(i, b), (h - a) / (b - a)
        return p and q and tuple(x * (1 - t) + y * t for x, y in zip(p, q))

    hv, out = [], []
    for i in range(20, len(bars) - 250):
        hv.append(round(moments(i, 20)[0] * 244**0.5 * 100, 6))
        rank = 100 * sum(v < hv[-1] for v in hv) / len(hv)
        scale = 1.15 if rank >= 66 else 1.0 if rank >= 33 else 0.88
        for h in H:
            if at(i, h) is None:
                continue
            sigma, mu = at(i, h)
            hi, lo = max(high[i + 1 : i + 1 + h]), min(low[i + 1 : i + 1 + h])
            for r in R:
                for d in (1, -1):
                    bar = close[i] * (1 + d * r) * (1 - d * min(sigma * h**0.5 * scale, 0.235))
                    if (close[i] - bar) * d >= 0:
                        p = 1.0
                    else:
                        a = math.log(bar / close[i])
                        sv, drift = sigma * h**0.5, mu if a >= 0 else -mu
                        p = 1 - cdf((abs(a) - drift * h) / sv) + math.exp(max(-50, min(50, 2 * mu * a / (sigma * sigma + 1e-12)))) * cdf((-abs(a) - drift * h) / sv)
                    out.append([i, h, r, d, min(0.999, max(0.001, p)), int(hi >= bar if d == 1 else lo <= bar)])
    return out


def test_calibration_samples_are_of_every_bar_and_the_whole_grid(spark):
    rng, p, rows = random.Random(11), 100.0, []
    for _ in range(530):
        p *= math.exp(rng.gauss(0.0003, 0.012))
        rows.append((p, p * 1.004, p * 0.996))
    b = spark.createDataFrame([("a", i, *x) for i, x in enumerate(rows)], "symbol string, i int, close double, high double, low double")
    got = sorted([x.i, x.h, x.r, x.dir, x.p, x.y] for x in probability.calibration_samples(b).collect())
    want = sorted(samples_by_hand(rows))
    assert len(want) == 12 * sum(280 - max(0, {20: 20, 40: 60, 60: 60, 90: 120, 120: 120, 180: 250, 250: 250}[h]) for h in H)
    off = [(x, y) for x, y in zip(got, want) if not close_to([x], [y], 5e-4)]  # the approximated normal distribution
    assert len(got) == len(want) and not off, (len(off), off[:3])


def test_calibration_samples_of_the_twins_grid_equal_the_twin(spark, sf, duck):  # noqa: F811
    s = probability.calibration_samples(QUERIES["bars_daily_walk"](spark, sf), probability.HORIZONS, probability.AMPLITUDES, probability.STEP, probability.FIRST)
    got = s.selectExpr("symbol", "i", "h", "r", "dir", "cast(floor(p * 10000 + 0.001) as int) as p4", "y").toPandas()
    assert close_to(canon(got), canon(duck.execute(ORACLES["calibration_samples"]).df()))


def test_calibration_summaries_are_of_all_samples(spark, sf):
    n = QUERIES["calibration_samples"](spark, sf).count()
    sums = {q: QUERIES[q](spark, sf).toPandas() for q in ("calibration_bins", "calibration_slope", "bucket_recal", "calib_2d", "brier_grouping_sets")}
    assert sums["calibration_bins"].n.sum() == sums["calibration_slope"].n.sum() == sums["bucket_recal"].n.sum() == sums["brier_grouping_sets"].n.max() == n
    assert set(zip(sums["calib_2d"].h, sums["calib_2d"].r, sums["calib_2d"].dir)) == {(h, r, d) for h in H for r in R for d in (1, -1)}


def test_asof_forward_takes_the_dates_of_all_orders(spark, sf, duck):  # noqa: F811
    got = {(x.symbol, x.at): x.i for x in QUERIES["asof_forward"](spark, sf).collect()}
    series = {}
    for x in QUERIES["bars_daily_walk"](spark, sf).orderBy("i").collect():
        series.setdefault(x.symbol, []).append(x.date)
    points = duck.execute("select distinct l_returnflag, cast(o_orderdate as date)::varchar from lineitem join orders on o_orderkey = l_orderkey").fetchall()
    assert got == {(s, d): next((i for i, e in enumerate(series[s]) if e >= d), len(series[s]) - 1) for s, d in points}
    assert got == {(s, d): i for s, d, i in duck.execute(ORACLES["asof_forward"]).fetchall()}


def test_business_day_distance_has_a_row_for_each_order(spark, sf, duck):  # noqa: F811
    got = {x.o_orderkey: x.bdays for x in QUERIES["business_day_distance"](spark, sf).collect()}
    rows = duck.execute("select o_orderkey, cast(o_orderdate as date) from orders").fetchall()
    assert got == {k: sum((d + timedelta(n)).weekday() < 5 for n in range(1, k % 40 + 1)) for k, d in rows}
    assert got == dict(duck.execute(ORACLES["business_day_distance"]).fetchall())


@pytest.mark.parametrize("name", ["source_kline_json", "source_columnar_json", "source_pipe_table"])
def test_sources_carry_all_bars(spark, sf, duck, name):  # noqa: F811
    columns = "symbol date open high low close volume".split()
    got = {(x.symbol, x.date): x for x in QUERIES[name](spark, sf).select(columns).collect()}
    b = QUERIES["bars_daily_walk"](spark, sf).collect()
    assert len(got) == len(b) and max(x.i for x in b) > 500
    for x in b:
        opened = x.close if name == "source_columnar_json" and x.i % 9 == 0 else x.open
        assert tuple(got[x.symbol, x.date]) == (x.symbol, x.date, opened, x.high, x.low, x.close, x.volume)
    part = duck.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert len(part) == len(got) and all(tuple(got[x[0], x[1]]) == x for x in part)


def test_source_fallback_shortens_only_the_source_that_is_too_short(spark, sf):
    n = {x.symbol: x.n for x in QUERIES["source_wrapped_json"](spark, sf).collect()}
    assert {(x.symbol, x.rank, x.n) for x in QUERIES["source_fallback"](spark, sf).collect()} == {(s, 2 if s == "N" else 1, k) for s, k in n.items()}


def test_permutation_test_makes_a_thousand_shuffles(spark, sf):
    x = sentiment.labelled(bars(spark, sf)).where("fwd is not null").select("symbol", "i", "score", "fwd").cache()
    perms = x.crossJoin(spark.range(1, 1001).selectExpr("cast(id as int) as perm")).selectExpr("symbol", "perm", "i", "xxhash64(i, perm) as k").toPandas()
    rows, want = x.orderBy("i").toPandas(), {}
    for symbol, own in rows.groupby("symbol"):
        fwd = own.set_index("i").fwd
        strong = lambda f: abs(np.corrcoef(own.score, f)[0, 1])
        real, mine = strong(own.fwd), perms[perms.symbol == symbol]
        want[symbol] = sum(strong(fwd.loc[p.sort_values("k").i]) >= real for _, p in mine.groupby("perm")) / 1000
    assert {r.symbol: r.p_value for r in QUERIES["permutation_test"](spark, sf).collect()} == want
    assert any(round(p * 1000) % 5 for p in want.values())
