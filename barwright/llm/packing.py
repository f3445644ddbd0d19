"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Sizes are integers from 1 to the capacity, so an instance of any number of documents is a histogram of at most
`capacity` counts. The driver gets that histogram (its size is bounded by the parameter), plans on it, and sends back
a table of patterns; pieces find their place by their rank among the pieces of the same size. No document, however
many there are, passes through the driver.

Plan. Reduction: for the largest size s with residual r = capacity - s, a set is fixed for good where it dominates
every other set that s could be packed with: {s} if nothing fits r; {s, t} if t fills r exactly, or if no two pieces
fit r together and t is the largest that fits; {s, t, u} if at most two pieces fit r and (t, u) bounds every feasible
pair and single, place by place. Each fix holds for as many copies as the counts allow. This repeats until nothing
more is fixed. The remainder is packed best-fit, largest first, with equal open sequences kept as one group.

Edge cases: a null or empty text is one token (the end id); a text of more than `capacity` tokens is cut into
full pieces after a first, shorter one; repeated rows are packed as often as they occur; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import VOCABULARY, Encoder, prefix_sum, table, write_shared

CAPACITY = 2048
Pattern = tuple[tuple[int, ...], int]


class _Counts:
    """A histogram with the sizes in use kept sorted."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c}
        self.sizes = sorted(self.n)

    def at_most(self, r: int, but: tuple[int, ...] = ()) -> int:
        """The largest size of at most r that is left besides the pieces in `but`, or 0."""
        i = bisect.bisect_right(self.sizes, r) - 1
        while i >= 0 and self.n[self.sizes[i]] <= but.count(self.sizes[i]):
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, k: int, but: int) -> list[int]:
        """The k smallest pieces besides one of size `but`."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.n[s] - (s == but))
            if len(out) >= k:
                break
        return out

    def second(self, r: int, but: int) -> int:
        """The largest b for which a further piece of size a >= b has a + b <= r."""
        i = bisect.bisect_right(self.sizes, r // 2) - 1
        while i >= 0:
            b = self.sizes[i]
            left = self.n[b] - (b == but)
            if left >= 2:
                return b
            up = next((a for a in self.sizes[i + 1 :] if self.n[a] > (a == but)), 0) if left else 0
            if up and up + b <= r:
                return b
            i -= 1
        return 0

    def take(self, pieces: tuple[int, ...], times: int) -> None:
        for s in pieces:
            self.n[s] -= times
            if not self.n[s]:
                del self.n[s]
                self.sizes.remove(s)


def dominant(c: _Counts, s: int, capacity: int) -> tuple[int, ...] | None:
    """The set with s that dominates all others, or None."""
    r = capacity - s
    t = c.at_most(r, (s,))
    if not t:
        return (s,)
    low = c.smallest(3, s)
    if t == r or len(low) < 2 or low[0] + low[1] > r:
        return (s, t)
    if len(low) < 3 or sum(low) > r:
        u = c.at_most(r - t, (s, t))
        if u and c.second(r, s) <= u:
            return (s, t, u)
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """The patterns fixed for good, and the counts that are left."""
    c, fixed, changed = _Counts(counts), [], True
    while changed:
        changed = False
        for s in sorted(c.n, reverse=True):
            while c.n.get(s) and (found := dominant(c, s, capacity)):
                times = min(c.n[x] // found.count(x) for x in set(found))
                c.take(found, times)
                fixed.append((found, times))
                changed = True
    return fixed, c.n


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over groups of equal open sequences."""
    full: list[Pattern] = []
    room: dict[int, list[Pattern]] = {}
    rests: list[int] = []

    def put(pieces: tuple[int, ...], times: int, rest: int) -> None:
        if not times:
            return
        if not rest:
            full.append((pieces, times))
            return
        if rest not in room:
            room[rest] = []
            bisect.insort(rests, rest)
        room[rest].append((pieces, times))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            i = bisect.bisect_left(rests, s)
            if i == len(rests):
                per = capacity // s
                put((s,) * per, left // per, capacity - per * s)
                put((s,) * (left % per), 1 if left % per else 0, capacity - left % per * s)
                break
            rest = rests[i]
            pieces, times = room[rest].pop()
            if not room[rest]:
                del room[rest]
                rests.pop(i)
            n = min(left, times)
            if times > n:
                put(pieces, times - n, rest)
            put((*pieces, s), n, rest - s)
            left -= n
    return full + [x for some in room.values() for x in some]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns (sizes of one sequence, number of such sequences) that use every piece once."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (size, first rank, first sequence, offset), sorted: where the pieces of each size go."""
    rows, used, sequence = [], {}, 0
    for pieces, times in patterns:
        offset = 0
        for s in pieces:
            rows.append((s, used.get(s, 0), sequence, offset))
            used[s] = used.get(s, 0) + times
            offset += s
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """One row per piece of each document's token ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.get(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                some, rows = batch.slice(at, 256), []
                for doc, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1))):
                    ids += end
                    n = len(ids) // 4
                    start, length = 0, n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                        start, length = start + length, capacity
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES_DDL)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    pieces = write_shared(token_pieces(docs, capacity, vocabulary, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = slots(plan(histogram, capacity))
    keys = (where[:, 0] << 44) + where[:, 1]
    ranked = prefix_sum(pieces.withColumn("one", F.lit(1)), ["length"], "doc_id", "one", "rank", ties=["piece"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            row = where[np.searchsorted(keys, (size << 44) + rank, "right") - 1] if len(b) else where[:0]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES_DDL + ", sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
