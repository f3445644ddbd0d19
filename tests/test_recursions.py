"""Recursions by blocks and states over sorted rows, against plain restatements; what queries read, and the entry without llm."""

import math
import os
import random
import shutil
import subprocess
import sys
from types import SimpleNamespace

import pytest

from barwright.functions.recursions import exponential, fold
from barwright.operators import binding, indicators, strokes, waves
from barwright.plans.catalogue import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def series(n=1000, seed=1):
    rng = random.Random(seed)
    return [("one", i, None if rng.random() < 0.1 or i < 3 else rng.gauss(0, 1), 2.5) for i in range(n)] + [("two", i, float(i % 5), -1.0) for i in range(9)] + [("none", i, None, None) for i in range(4)] + [(None, 0, 1.0, None)]


def plainly(rows, alpha, seeded):
    out, y = {}, {}
    for s, i, x, seed in rows:
        if x is None or seeded and seed is None:
            out[s, i] = None
            continue
        before = y.get(s, seed if seeded else x)
        y[s] = out[s, i] = before + alpha * (x - before)
    return out


@pytest.mark.parametrize("block", [7, 100, None])
def test_exponential_means_by_blocks(spark, block):
    rows = series(3000 if block is None else 900)
    df = spark.createDataFrame(rows, "symbol string, i int, x double, seed double")
    got = exponential(df, {"a": ("x", 2 / 13), "b": ("x", 0.06, "seed")}, block).collect()
    assert len(got) == len(rows)
    for name, want in (("a", plainly(rows, 2 / 13, False)), ("b", plainly(rows, 0.06, True))):
        for r in got:
            v = want[r.symbol, r.i]
            assert (r[name] is None) == (v is None) and (v is None or math.isclose(r[name], v, rel_tol=1e-9, abs_tol=1e-12)), (name, r)


def test_indicators_by_small_blocks(spark, sf, monkeypatch):
    names = ("ema_fast_slow", "macd", "rsi14", "adx_ewm", "ewma_vol", "adx_wilder", "sig_indicator_vote")
    want = {n: sorted(map(str, QUERIES[n](spark, sf).collect())) for n in names}
    small = lambda rows, means: exponential(rows, means, 97)
    monkeypatch.setattr(indicators, "exponential", small)
    monkeypatch.setattr(waves, "exponential", small)
    for n in names:
        assert sorted(map(str, QUERIES[n](spark, sf).collect())) == want[n], n


def test_no_python_in_exponential_means(spark, sf):
    for n in ("ema_fast_slow", "macd", "rsi14", "adx_ewm", "ewma_vol", "adx_wilder", "sig_indicator_vote", "mean_reverting_vol"):
        plan = QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Pandas" not in plan and "Python" not in plan, n


@pytest.fixture
def three_row_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)


STATES = [
    (strokes.Merging, "high double, low double, i0 int, i1 int"),
    (strokes.Turning, "stroke int, end int, p double"),
    (strokes.Growing, "start int, end int, zg double, zd double, gg double, dd double, count int"),
    (waves.zigzag_state(0.03), "i int, price double, type string, unconfirmed boolean"),
]


@pytest.mark.parametrize("state,columns", STATES)
def test_states_pass_over_small_batches_and_many_symbols(spark, three_row_batches, state, columns):
    rng, rows = random.Random(7), []
    for s in [f"s{k}" for k in range(9)] + [None]:
        p = 100.0
        for i in range(rng.choice((1, 2, 3, 40, 61))):
            p *= math.exp(rng.gauss(0, 0.03))
            rows.append((s, i, i, p * 1.01, p * 0.99, i, i + 1, p))
    names = ["symbol", "i", "no", "high", "low", "start", "end", "p1"]
    df = spark.createDataFrame(rows, "symbol string, i int, no int, high double, low double, start int, end int, p1 double")
    got = sorted((tuple(r) for r in fold(df.repartition(2), state, "i", columns).collect()), key=str)
    want = []
    for s in {r[0] for r in rows}:
        one, out = state(), []
        for r in rows:
            if r[0] == s:
                out += list(one.take(SimpleNamespace(**dict(zip(names, r)))))
        out += list(one.rest())
        want += [(s, n, *x) for n, x in enumerate(out)]
    assert got == sorted(want, key=str)


READERS = ["structure_summary", "signal_plans", "sig_strokes", "thinned_signals", "forecast_confidence", "point_backtest"]


@pytest.mark.parametrize("name,shuffles", [("structure_summary", "4"), *((n, "12") for n in READERS)])
def test_readers_of_points_on_more_rows(spark, name, shuffles):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["scenario", "structure_summary", "bound_targets", "forecast_confidence", "health_score"])
def test_lines_are_read_once(spark, sf, monkeypatch, name):
    from barwright.sources.shared import kept

    scans = []
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def counted(df):
        scans.append(text(df).count("lineitem.parquet"))
        return kept(df)

    for module in (strokes, binding):
        monkeypatch.setattr(module, "kept", counted)
    scans.append(text(QUERIES[name](spark, sf)).count("lineitem.parquet"))
    assert sum(scans) == 1


def test_entry_without_the_training_data_operators(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(x.startswith('op1') for x in q) and len(q) > 250; e.oracle_sql(); import bench"
    subprocess.run([sys.executable, "-c", code], cwd=at, check=True, env=os.environ | {"PYTHONPATH": str(at)})


def test_weight_search_by_plain_ranks(spark, sf):
    import numpy as np

    from barwright.operators import sentiment
    from barwright.sources.bars import bars

    x = sentiment.search_rows(bars(spark, sf)).where("i < 420").cache()
    got = sentiment.searched(x, sets=60, a_task=16).collect()
    rows = x.orderBy("symbol", "i").collect()

    def spearman(a, b):
        if len(a) < 10:
            return 0.0
        ranks = []
        for v in (a, b):
            order = sorted(range(len(v)), key=lambda k: v[k])
            place = [0] * len(v)
            for r, k in enumerate(order):
                place[k] = r
            ranks.append(place)
        return float(np.corrcoef(*ranks)[0, 1])

    for symbol in {r.symbol for r in rows}:
        own = [r for r in rows if r.symbol == symbol]
        cut, found = int(len(own) * 0.7), []
        for k in range(1, 61):
            (w,), (span,) = sentiment.weight_sets(k, k)
            assert abs(sum(w) - 1) < 1e-12 and min(w) > 0.03
            mom = {10: "mom10", 20: "mom", 30: "mom30", 40: "mom40"}[int(span)]
            score = [min(100, max(0, 50 + 50 * (w[0] * r[mom] + w[1] * r.pos + w[2] * r.vol + w[3] * r.volat))) for r in own]
            ahead = [r.fwd for r in own]
            found.append((spearman(score[:cut], ahead[:cut]), k, spearman(score[cut:], ahead[cut:])))
        want = [f for f in sorted(found) if f[0] < 0][:10]
        mine = sorted((r.place, r.k, r.r_train, r.r_test, r.n_train + r.n_test) for r in got if r.symbol == symbol)
        assert len(mine) == len(want)
        for (_, _, train, test, n), (t, _, o) in zip(mine, want):
            assert abs(train - t) < 1e-3 and n == len(own)
        assert all(abs(m[3] - dict((k, o) for _, k, o in found)[m[1]]) < 2e-3 for m in mine)
