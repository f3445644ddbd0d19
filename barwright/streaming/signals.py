"""Signals of strokes and the fate of written targets as streams with keyed state, event-time timers and a watermark.

Both replay as registered queries: bars arrive in several runs of one stream, and what the stream has given in the end
equals the batch query on all bars."""

from __future__ import annotations

import pickle
import uuid
from collections import namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.probability import EVAL, banded, target_log
from ..operators.reports import SIG_STROKES_SQL
from ..operators.strokes import DAY, WANING, Growing, Merging, pairing
from ..plans.registry import query
from ..sources.bars import bars
from ..sources.shared import kept, shared_folder

Bar = namedtuple("Bar", "i high low")
Merged = namedtuple("Merged", "no high low i0 i1 before after")
Fractal = namedtuple("Fractal", "symbol at kind high low i0 i1 before after")
Stroke = namedtuple("Stroke", "no start end dir p0 p1 high low i1 area")
DAY_MS = 86_400_000


class StrokeSignals:
    """The structure of one symbol so far: the open merged bar, the last merged bars, the pending end, the open zone, momentum, and
    the divergences and zones that wait for their stroke. take() gives the signals that a bar settles, rest() those that the
    end of the series does."""

    def __init__(self):
        self.merging, self.growing, self.end = Merging(), Growing(), None
        self.means: list[float] | None = None
        self.sums, self.running = {}, (0.0, 0.0)
        self.near: list[Merged] = []
        self.last_end: Fractal | None = None
        self.strokes: list[Stroke] = []
        self.count = self.bars = 0
        self.divergences: list[Stroke] = []
        self.zones: list[tuple] = []

    def take(self, i: int, high: float, low: float, close: float) -> list[tuple]:
        if self.means is None:
            self.means = [close, close, 0.0]
        else:
            fast, slow, dea = self.means
            fast, slow = fast + 2 / 13 * (close - fast), slow + 2 / 27 * (close - slow)
            self.means = [fast, slow, dea + 2 / 10 * (fast - slow - dea)]
        hist, before = 2 * (self.means[0] - self.means[1] - self.means[2]), self.running
        self.running = before[0] + max(hist, 0.0), before[1] + max(-hist, 0.0)
        self.sums[i] = before, self.running
        return [s for m in self.merging.take(Bar(i, high, low)) for s in self._merged(*m)]

    def rest(self) -> list[tuple]:
        return [s for m in self.merging.rest() for s in self._merged(*m)]

    def _merged(self, high: float, low: float, i0: int, i1: int) -> list[tuple]:
        m = Merged(self.bars, high, low, i0, i1, self.sums[i0][0], self.sums[i1][1])
        self.bars += 1
        self.sums = {i: x for i, x in self.sums.items() if i > i1}
        self.near = [*self.near, m][-3:]
        if len(self.near) < 3:
            return []
        a, f, b = self.near
        top = f.high >= max(a.high, b.high) and f.low >= max(a.low, b.low)
        bottom = f.low <= min(a.low, b.low) and f.high <= min(a.high, b.high)
        if not top and not bottom:
            return []
        state = pairing(DAY, 2)()
        state.end = self.end
        ends = [Fractal(None, *e) for e in state.take(Fractal(None, f.no, 1 if top else -1, f.high, f.low, f.i0, f.i1, f.before, f.after))]
        self.end = state.end
        return [s for e in ends for s in self._ended(e)]

    def _ended(self, e: Fractal) -> list[tuple]:
        b, self.last_end = self.last_end, e
        if b is None:
            return []
        up = b.kind < 0
        side = 0 if up else 1
        s = Stroke(self.count, b.at, e.at, 1 if up else -1, b.low if up else b.high, e.high if up else e.low, max(b.high, e.high), min(b.low, e.low), e.i1, round(e.after[side] - b.before[side], 6))
        self.count += 1
        return self._stroke(s)

    def _stroke(self, s: Stroke) -> list[tuple]:
        kinds = []
        q = self.strokes[-2] if len(self.strokes) > 1 else None
        if q and q.area > 0 and s.dir == q.dir and s.area < q.area * WANING and (s.p1 - q.p1) * s.dir > 0:
            kinds.append((1, -s.dir))
        settled = [d for d in self.divergences if d.dir == s.dir and (s.p1 - d.p1) * d.dir < 0]
        kinds += [(2, -s.dir) for _ in settled]
        back = lambda z: s.start > z[1] and (s.dir == -1 and s.p0 > z[2] and s.p1 > z[3] or s.dir == 1 and s.p0 < z[3] and s.p1 < z[2])
        come_back = [z for z in self.zones if back(z)]
        kinds += [(3, -s.dir) for _ in come_back]
        self.divergences = [d for d in self.divergences if d not in settled] + ([s] if kinds and kinds[0][0] == 1 else [])
        self.zones = [z for z in self.zones if z not in come_back] + list(self.growing.take(s))
        self.strokes = [*self.strokes, s][-2:]
        return [(s.i1, min(kinds)[1], min(kinds)[0])] if kinds else []


class SignalProcessor(StatefulProcessor):
    """One StrokeSignals a symbol. A symbol that is quiet for `quiet` days is closed by its timer: its last bar is then final."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "state binary, seen int, until long")

    def _rows(self, symbol: str, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(symbol, *x) for x in found], columns=["symbol", "i", "signal", "kind"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows)).dropna(subset=["i"]).sort_values("i")
        if p.empty:
            return
        one, seen, until, found = StrokeSignals(), -1, None, []
        if self.machine.exists():
            state, seen, until = self.machine.get()
            one = pickle.loads(state)
        for i, high, low, close in zip(p["i"].astype(int).tolist(), p["high"].tolist(), p["low"].tolist(), p["close"].tolist()):
            if i > seen:  # a bar that comes again, or after a later one, cannot change what was said
                found += one.take(i, high, low, close)
                seen = i
        if until is not None:
            self.handle.deleteTimer(until)
        until = int(p["at"].max().timestamp() * 1000) + self.quiet * DAY_MS
        self.handle.registerTimer(until)
        self.machine.update((pickle.dumps(one), seen, until))
        yield self._rows(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.machine.exists():
            state, _, _ = self.machine.get()
            self.machine.clear()
            yield self._rows(key[0], pickle.loads(state).rest())

    def close(self) -> None:
        pass


def streaming_signals(stream: DataFrame, quiet: int = 60) -> DataFrame:
    """symbol, i, signal, kind of a stream of bars (symbol, at, i, high, low, close), each given once it is final."""
    g = stream.withWatermark("at", "0 seconds").groupBy("symbol")
    return g.transformWithStateInPandas(SignalProcessor(quiet), "symbol string, i int, signal int, kind int", "append", "eventTime")


class TargetProcessor(StatefulProcessor):
    """The targets of one symbol that have not been reached. A timer for each fires the miss when its window closes; a target
    that is reached later is still given as a hit, with its bars. Event time counts bars."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "i int, key string", "side string, price double, expect int, edge double")
        self.edges = handle.getValueState("edges", "sell double, buy double")

    def _bounds(self) -> None:
        rows = [v for _, v in self.open.iterator()]
        self.edges.update((min((v[3] for v in rows if v[0] == "sell"), default=float("inf")), max((v[3] for v in rows if v[0] == "buy"), default=float("-inf"))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows)).dropna(subset=["i"])
        found = []
        for r in p.sort_values(["i", "target"]).itertuples(index=False):
            i = int(r.i)
            if r.target:  # after the bar on which it was written
                edge = r.price * (1 - r.frac) if r.side == "sell" else r.price * (1 + r.frac)
                self.open.updateValue((i, r.key), (r.side, r.price, int(r.expect), edge))
                sell, buy = self.edges.get() if self.edges.exists() else (float("inf"), float("-inf"))
                self.edges.update((min(sell, edge), buy) if r.side == "sell" else (sell, max(buy, edge)))
                self.handle.registerTimer((i + int(r.expect) + 1) * DAY_MS)
            elif self.edges.exists():
                sell, buy = self.edges.get()
                if r.high >= sell or r.low <= buy:  # most bars reach nothing
                    for (at, name), (side, price, expect, edge) in list(self.open.iterator()):
                        if (r.high >= edge) if side == "sell" else (r.low <= edge):
                            found.append((key[0], at, name, side, price, expect, i - at, "hit"))
                            self.open.removeKey((at, name))
                    self._bounds()
        yield pd.DataFrame(found, columns=FATE_COLUMNS).astype({"days": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        found = [(key[0], i, name, side, price, expect, None, "miss") for (i, name), (side, price, expect, _) in self.open.iterator() if i + expect == at]
        yield pd.DataFrame(found, columns=FATE_COLUMNS).astype({"days": "Int32"})

    def close(self) -> None:
        pass


FATE = "symbol string, i int, key string, side string, price double, expect int, days int, state string"
FATE_COLUMNS = [c.split()[0] for c in FATE.split(", ")]


def streaming_targets(stream: DataFrame) -> DataFrame:
    """Hits and misses of a stream of bars and targets: rows (symbol, at, i, target, high, low, key, side, price, expect, frac) where
    `at` is bar i as day i + 1 since 1970 (the watermark begins at 1970 itself)."""
    g = stream.withWatermark("at", "0 seconds").groupBy("symbol")
    return g.transformWithStateInPandas(TargetProcessor(), FATE, "append", "eventTime")


# -------------------------------------------------------------------------------------------------------------- replay
def replay(pieces: list[DataFrame], stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives when the pieces arrive one after another: each is written to the stream's folder, and the stream runs
    from its checkpoint until it has taken it in. A session of its own holds the state store's settings."""
    spark = pieces[0].sparkSession
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    at = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    for piece in pieces:
        piece.write.mode("append").parquet(f"{at}/in")
        given = stream(own.readStream.schema(piece.schema).parquet(f"{at}/in"))
        run = given.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(given.schema).parquet(f"{at}/out")


def in_pieces(rows: DataFrame, n: int, end: str) -> list[DataFrame]:
    """rows (symbol, at, ...) in n pieces by time, and a last one with a row of no bar at the time `end`, which moves the watermark."""
    first, last = rows.agg(F.unix_timestamp(F.min("at")), F.unix_timestamp(F.max("at"))).first()
    piece = F.least(F.floor((F.unix_timestamp("at") - first) * n / max(1, last - first)), F.lit(n - 1))
    mark = rows.agg(F.max("at").alias("at")).select(*[F.lit("#").alias(c) if c == "symbol" else F.expr(end).alias(c) if c == "at" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return [rows.where(piece == k) for k in range(n)] + [mark]


@query("sig_strokes_stream", SIG_STROKES_SQL)
def sig_strokes_stream(spark, sf_dir):
    """The signals of strokes, as a stream gives them whose bars come in three runs."""
    b = kept(bars(spark, sf_dir).select("symbol", F.col("date").cast("timestamp").alias("at"), "i", "high", "low", "close"))
    return replay(in_pieces(b, 3, "at + interval 1000 days"), streaming_signals).select("symbol", "i", "signal", "kind")


@query("backtest_evaluate_stream", EVAL + "select symbol, i, key, side, price, expect::int as expect, days, state from ev2", bars=True)
def backtest_evaluate_stream(spark, sf_dir):
    """Every written target with what the stream said of it last: hits and misses as they came, and pending where it said nothing."""
    b = kept(bars(spark, sf_dir))
    log = kept(banded(target_log(b), b))
    time = F.timestamp_seconds((F.col("i").cast("long") + 1) * 86_400)
    none = lambda *cols: [F.lit(None).cast(t).alias(c) for c, t in cols]
    one = b.select("symbol", time.alias("at"), "i", F.lit(False).alias("target"), "high", "low", *none(("key", "string"), ("side", "string"), ("price", "double"), ("expect", "int"), ("frac", "double")))
    two = log.select("symbol", time.alias("at"), "i", F.lit(True).alias("target"), *none(("high", "double"), ("low", "double")), "key", "side", "price", "expect", "frac")
    said = replay(in_pieces(kept(one.union(two)), 3, "at"), streaming_targets)
    last = said.groupBy("symbol", "i", "key").agg(F.max("days").alias("days"), F.min("state").alias("state"))  # a hit comes before a miss
    x = log.select("symbol", "i", "key", "side", "price", "expect").join(last, ["symbol", "i", "key"], "left")
    return x.select("symbol", "i", "key", "side", "price", "expect", "days", F.coalesce("state", F.lit("pending")).alias("state"))
