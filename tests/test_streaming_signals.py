"""Streams with keyed state against batch results: any cut into runs, repeated and late bars, hits after a miss, empty runs."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from barwright.operators.reports import sig_strokes
from barwright.sources.bars import bars
from barwright.streaming.signals import StrokeSignals, replay, streaming_targets


@pytest.mark.parametrize("cuts", [1, 7, 400])
def test_signals_after_any_cut(spark, sf, cuts):
    """The state, pickled at every cut, gives what the batch query gives."""
    import pickle

    rng, got = random.Random(cuts), []
    rows = bars(spark, sf).orderBy("symbol", "i").collect()
    for symbol, own in groupby(rows, key=lambda r: r.symbol):
        own = list(own)
        at = set(rng.sample(range(len(own)), min(cuts, len(own) - 1)))
        one = StrokeSignals()
        for n, r in enumerate(own):
            if n in at:
                one = pickle.loads(pickle.dumps(one))
            got += [(symbol, *x) for x in one.take(r.i, r.high, r.low, r.close)]
            assert len(one.sums) < 200 and len(one.strokes) <= 2
        got += [(symbol, *x) for x in one.rest()]
    want = [(r.symbol, r.i, r.signal, r.kind) for r in sig_strokes(spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) > 50


TARGETS = "symbol string, at timestamp, i int, target boolean, high double, low double, key string, side string, price double, expect int, frac double"


def bar(symbol, i, high, low):
    return (symbol, i, False, float(high), float(low), None, None, None, None, None)


def target(symbol, i, key, side, price, expect):
    return (symbol, i, True, None, None, key, side, price, expect, 0.0)


def test_targets_hit_missed_and_hit_after_a_miss(spark):
    rows = [bar("a", i, 10 + i, 9 + i) for i in range(8)] + [bar("b", i, 5.0, 4.0) for i in range(8)]
    rows += [target("a", 0, "near", "sell", 12.0, 3), target("a", 0, "late", "sell", 16.0, 2), target("a", 2, "own", "sell", 12.0, 2), target("a", 5, "far", "sell", 99.0, 9), target("a", 1, "no", "buy", 1.0, 3)]
    rows += [target("b", 6, "open", "buy", 1.0, 2), target("b", 3, "shut", "buy", 1.0, 4), target("b", 4, "touch", "sell", 5.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, i int, target boolean, high double, low double, key string, side string, price double, expect int, frac double")
    df = df.withColumn("at", F.timestamp_seconds((F.col("i").cast("long") + 1) * 86_400)).select("symbol", "at", "i", "target", "high", "low", "key", "side", "price", "expect", "frac")
    mark = df.limit(1).select(F.lit("#").alias("symbol"), F.timestamp_seconds(F.lit(8 * 86_400)).alias("at"), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns[2:]])
    said = replay([df.where("i < 3"), df.where("i between 3 and 5"), df.where("i > 5"), mark], streaming_targets)
    got = sorted((r.key, r.state, r.days) for r in said.collect())
    assert [x for x in got if x[1] == "hit"] == [("late", "hit", 6), ("near", "hit", 2), ("own", "hit", 1), ("touch", "hit", 1)]
    assert [x[0] for x in got if x[1] == "miss"] == ["late", "no", "shut"]
