"""Operators against hand-made cases and plain restatements."""

import math
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from barwright.functions.columns import by, first_passage_sql, normal_cdf_sql
from barwright.operators import binding, candles, probability, strokes, waves
from barwright.operators.alignment import business_days, repair_volume
from barwright.operators.indicators import trend_strength
from barwright.sources import ingest


def test_normal_cdf_close_to_erf(spark):
    x = spark.sql(f"select x, {normal_cdf_sql('x')} as p from (select (id - 50) / 10.0D as x from range(101))").collect()
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.x / 2**0.5))) < 1e-7 for r in x)


def test_first_passage_without_drift(spark):
    got = spark.sql(f"select {first_passage_sql('a', 'mu', 's', 't')} as p from (select 0.1D as a, 0.0D as mu, 0.01D as s, 60.0D as t)").first().p
    assert abs(got - 2 * 0.5 * (1 + math.erf(-0.1 / (0.01 * 60**0.5) / 2**0.5))) < 1e-6


def test_windows_refuse_an_empty_key():
    with pytest.raises(ValueError):
        by(())


def zigzag_rows(rows, pct):
    """(price, bar, type, pending) of the state over plain rows (bar, high, low)."""
    z = waves.zigzag_state(pct)()
    found = [x for i, high, low in rows for x in z.take(SimpleNamespace(i=i, high=high, low=low))]
    return [(price, i, kind, pending) for i, price, kind, pending in found + (z.rest() if rows else [])]


def test_zigzag_alternates_and_moves_enough():
    rng, p, rows = random.Random(3), 100.0, []
    for i in range(500):
        p *= math.exp(rng.gauss(0, 0.02))
        rows.append((i, p * 1.005, p * 0.995))
    z = zigzag_rows(rows, 0.08)
    assert len(z) > 5 and all(a[2] != b[2] for a, b in zip(z, z[1:]))
    assert all(abs(b[0] / a[0] - 1) >= 0.07 for a, b in zip(z[:-2], z[1:-1]))
    assert zigzag_rows([], 0.1) == [] and zigzag_rows(rows[:1], 0.1) == []


def test_streaming_zigzag_equals_batch(spark, tmp_path):
    rng, p, rows = random.Random(5), 50.0, []
    for i in range(300):
        p *= math.exp(rng.gauss(0, 0.02))
        rows.append(("a" if i % 3 else "b", i, round(p * 1.004, 4), round(p * 0.996, 4)))
    from barwright.streaming.bars import streaming_zigzag

    schema = "symbol string, i long, high double, low double"
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).json(str(tmp_path / "in"))
    q = streaming_zigzag(stream, 0.05).writeStream.format("memory").queryName("zz").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.symbol, r.i, r.price, r.type) for r in spark.table("zz").collect())
    want = sorted((s, i, price, kind) for s in "ab" for price, i, kind, pending in zigzag_rows([x[1:] for x in rows if x[0] == s], 0.05) if not pending)
    assert got == want


def test_streaming_bars_equal_batch(spark, sf, tmp_path):
    from barwright.sources.bars import table, tick_bars
    from barwright.streaming.bars import streaming_tick_bars

    ev = table(spark, sf, "events")
    ev.write.parquet(str(tmp_path / "ev"))
    q = streaming_tick_bars(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("tb").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = tick_bars(ev)
    got = spark.table("tb").select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_upsert_adds_each_key_once(spark, tmp_path):
    from barwright.streaming.bars import upsert_batches

    sink = upsert_batches(str(tmp_path / "log"), ("k",))
    sink(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    sink(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), 1)
    sink(spark.createDataFrame([(4, "f"), (4, "e")], "k int, v string"), 2)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "log")).collect())) == [(1, "a"), (2, "b"), (3, "d"), (4, "e")]


def test_inclusion_and_strokes(spark):
    b = spark.createDataFrame([("a", i, float(h), float(lo)) for i, (h, lo) in enumerate([(10, 8), (12, 9), (11, 10), (14, 11)])], "symbol string, i int, high double, low double")
    assert [tuple(r)[2:] for r in strokes.merged(b).orderBy("no").collect()] == [(10, 8, 0, 0), (12, 10, 1, 2), (14, 11, 3, 3)]
    path = [10, 11, 12, 13, 12, 11, 10, 9, 10, 11, 12, 13, 14]
    b = spark.createDataFrame([("a", i, p + 0.4, p - 0.4) for i, p in enumerate(path)], "symbol string, i int, high double, low double")
    s = strokes.strokes(b)
    assert [r["dir"] for r in s.collect()] == [-1]
    # one stroke opens no zone, and is the one leg there is
    assert strokes.zones(s).count() == 0 and [(r["dir"], r.start, r.end) for r in strokes.segments(s).collect()] == [(-1, 3, 7)]


def test_flat_bars_have_no_pattern(spark):
    b = spark.createDataFrame([("a", i, 10.0, 10.0, 10.0, 10.0) for i in range(5)], "symbol string, i int, open double, high double, low double, close double")
    assert {r.signal for r in candles.candle_vote(b).collect()} == {0}
    assert {r.f for r in candles.geometry(b).select(F.expr(candles.score("doji")).alias("f")).collect()} == {0}


def test_first_hits_over_blocks(spark):
    rng, rows, p = random.Random(8), [], 100.0
    for i in range(300):
        p *= math.exp(rng.gauss(0, 0.01))
        rows.append(("a", i, p * 1.003, p * 0.997))
    log = [("a", i, side, rows[i][2] * f, 50) for i in range(0, 300, 7) for side, f in (("sell", 1.04), ("buy", 0.96))]
    got = {(r.i, r.side): (r.state, r.days) for r in probability.evaluate(spark.createDataFrame(log, "symbol string, i int, side string, price double, expect int"), spark.createDataFrame(rows, "symbol string, i int, high double, low double"), block=16).collect()}
    for s, i, side, price, expect in log:
        j = next((j for j in range(i + 1, 300) if (rows[j][2] >= price * 0.995 if side == "sell" else rows[j][3] <= price * 1.005)), None)
        assert got[i, side] == (("hit", j - i) if j else ("pending" if i + expect > 299 else "miss", None))


def test_path_samples_are_the_analyses_of_cut_series(spark, sf):
    from barwright.sources.bars import bars

    b = bars(spark, sf).where("symbol = 'A' and i < 420").cache()
    got = {r.t: r.scenario for r in strokes.path_samples(b, horizon=60, step=50).collect()}
    assert set(got) == {260, 310}
    for t, scenario in got.items():
        assert strokes.scenarios(b.where(f"i <= {t}")).first().scenario == scenario
    b.unpersist()


def test_sources_reject_and_degrade(spark):
    one = spark.createDataFrame([("a", "Date,Close,Open\n2024-01-02,5,\nbad,1,1\n2024-01-03,x,2\n"), ("b", "<html>"), ("c", None)], "symbol string, payload string")
    assert [(r.symbol, r.date, r.open, r.close, r.volume) for r in ingest.parse_csv(one, "payload").collect()] == [("a", "2024-01-02", 5.0, 5.0, 0.0)]
    t = spark.createDataFrame([("a", "text\n| LAST | Date | Vol |\n|---|---|---|\n| 1,000.5 | 2024/01/02 | 7 |\n| x | 2024/01/03 | 7 |\n| 2 |\n")], "symbol string, body string")
    assert [(r.date, r.close, r.high, r.volume) for r in ingest.parse_any_pipe_table(t).collect()] == [("2024-01-02", 1000.5, 1000.5, 7.0)]


def test_written_pipe_tables_read_back(spark, sf, tmp_path):
    from barwright.sources.bars import bars

    b = bars(spark, sf).where("i < 40")
    ingest.write_pipe_tables(b, str(tmp_path / "t"))
    files = spark.read.text(str(tmp_path / "t"), wholetext=True).select("symbol", F.col("value").alias("body"))
    got = ingest.parse_any_pipe_table(files).select("symbol", "date", "open", "high", "low", "close", "volume")
    want = b.select("symbol", F.col("date").cast("string").alias("date"), "open", "high", "low", "close", "volume")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_rates_by_powers_of_two_equal_plain_windows(spark, sf):
    from barwright.sources.bars import bars

    b = bars(spark, sf).where("symbol = 'A' and i < 120")
    m = {(r.i, r.p): (r.hi, r.lo) for r in binding.windows_ahead(b).collect()}
    rows = [(r.high, r.low) for r in b.orderBy("i").collect()]
    for i in range(0, 60, 7):
        for n in (1, 3, 10, 37, 50):
            p = 1 << (n.bit_length() - 1)
            hi = max(m[i, p][0], m[i + n - p, p][0])
            assert hi == max(h for h, _ in rows[i + 1 : i + 1 + n])


def test_wilder_adx_needs_bars(spark):
    rows = [("long", i, i + 2.0, i + 1.0, i + 1.5) for i in range(60)] + [("short", i, i + 2.0, i + 1.0, i + 1.5) for i in range(20)]
    got = trend_strength(spark.createDataFrame(rows, "symbol string, i int, high double, low double, close double")).collect()
    assert [r.symbol for r in got] == ["long"] and got[0].adx > 90 and got[0].pdi > got[0].mdi


def test_business_days(spark):
    x = spark.sql("select date'2024-01-05' as a, date'2024-01-08' as b").select(business_days(F.col("a"), F.col("b")).alias("n")).first()
    assert x.n == 1


def test_volume_repair_needs_ten_bars(spark):
    b = spark.createDataFrame([("a", i, 1000.0 if i in (3, 30) else 10.0) for i in range(40)], "symbol string, i int, v double")
    got = {r.i: r.v for r in repair_volume(b, "v").collect()}
    assert got[3] == 1000.0 and got[30] == 10.0


def test_pending_until_the_window_closes(spark):
    b = spark.createDataFrame([("a", i, 100.0, 99.0) for i in range(50)], "symbol string, i int, high double, low double")
    log = spark.createDataFrame([("a", 10, "x", "sell", 120.0, 20), ("a", 40, "x", "sell", 120.0, 20), ("a", 10, "y", "buy", 99.2, 20)], "symbol string, i int, key string, side string, price double, expect int")
    got = {(r.i, r.key): (r.state, r.days) for r in probability.evaluate(log, b).collect()}
    assert got == {(10, "x"): ("miss", None), (40, "x"): ("pending", None), (10, "y"): ("hit", 1)}


def test_pava_is_isotonic_and_keeps_the_mean(spark):
    v = [0.1, 0.3, 0.2, 0.5, 0.4, 0.45, 0.9]
    bins = spark.createDataFrame([(i, 10 + i, x) for i, x in enumerate(v)], "bin int, n int, v double")
    got = [r.iso for r in probability.pava(bins).orderBy("bin").collect()]
    assert got == sorted(got)
    assert abs(sum((10 + i) * x for i, x in enumerate(got)) - sum((10 + i) * x for i, x in enumerate(v))) < 1e-9


def test_upsert_keeps_the_old_row(spark):
    old = spark.createDataFrame([("a", 1, "k", 5.0)], "symbol string, i int, key string, price double")
    new = spark.createDataFrame([("a", 1, "k", 6.0), ("a", 2, "k", 7.0), ("a", 2, "k", 8.0)], old.schema)
    assert sorted(r.price for r in probability.upsert_log(old, new).collect()) == [5.0, 7.0]


def test_log_skips_corrupt_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2\n{"a": 3}\n')
    assert sorted(r.a for r in ingest.read_log(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 3]


def test_pipe_table_degrades_by_row(spark):
    rows = ["| date | open | high | low | last | volume |", "|---|---|---|---|---|---|", "| 2024-01-02 | 1 | x | 0.5 | 1,000.5 | 7 |", "| n/a | 1 | 2 | 0.5 | 1 | 7 |", "| 2024-01-03 | 1 | 2 | 1 |", "text"]
    got = ingest.parse_pipe_table(spark.createDataFrame([(r,) for r in rows], "line string")).collect()
    assert [(r.date, r.close, r.high, r.volume) for r in got] == [("2024-01-02", 1000.5, 1000.5, 7.0)]


def test_first_source_needs_enough_rows(spark):
    c = spark.createDataFrame([("a", 0, i) for i in range(5)] + [("a", 1, i) for i in range(20)], "symbol string, rank int, v int")
    assert {r["rank"] for r in ingest.first_source(c, 10).collect()} == {1}
