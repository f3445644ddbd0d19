"""Helpers shared by the training-data operators: shared folders, hierarchical prefix sums, connected
components, vectorised word hashing over Arrow buffers, and tokenisation with a table of parts."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The word class of every contract: runs without space, tab, LF, VT, FF or CR.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 19
#: Spark's settings of the size of Arrow batches: name, Spark's default, what the operators here use instead.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"))


# ---------------------------------------------------------------------------------------------- shared folders
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="barwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 4 MB where the session sets no other bound: texts are long, and the default
    of 10,000 rows takes hundreds of MB in each worker."""
    for key, default, value in BATCHES:
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def write_shared(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/barwright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


# ------------------------------------------------------------------------------------------------ prefix sums
def prefix_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, ties: list[str] = ()) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys that come before in `order` (a long; null first).

    The order column is cut into digits of at most 16 bits, sums are carried from level to level, so no window
    holds the rows of more than 4,096 consecutive ids or more than 65,536 nodes (2**20 at the top, where ids span all 64
    bits), however hot a key is. Rows that repeat one id are told apart by `ties` and else get arbitrary places, each its own.
    """
    nn = F.coalesce(F.col(order), F.lit(-(2**63)))
    low = df.withColumn("_b0", F.shiftright(nn, 12))
    by = lambda *c: [*keys, *c]
    l0 = low.groupBy(*by("_b0")).agg(F.sum(value).alias("_v0")).withColumn("_b1", F.shiftright("_b0", 16))
    l1 = l0.groupBy(*by("_b1")).agg(F.sum("_v0").alias("_v1")).withColumn("_b2", F.shiftright("_b1", 16))
    l2 = l1.groupBy(*by("_b2")).agg(F.sum("_v1").alias("_v2"))

    def before(frame: DataFrame, part: list[str], at: list, v: str) -> Column:
        w = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy(*at)
        return F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    l2 = l2.select(*by("_b2"), before(l2, by(), ["_b2"], "_v2").alias("_o2"))

    def join(a: DataFrame, b: DataFrame, *c: str) -> DataFrame:
        at = {k: f"_r{i}" for i, k in enumerate(by(*c))}
        b = b.withColumnsRenamed(at)
        return a.join(b, [F.col(k).eqNullSafe(F.col(r)) for k, r in at.items()], "left").drop(*at.values())

    l1 = l1.select(*by("_b1", "_b2"), before(l1, by("_b2"), ["_b1"], "_v1").alias("_o1"))
    l1 = join(l1, l2, "_b2").select(*by("_b1"), (F.col("_o1") + F.col("_o2")).alias("_o1"))
    l0 = l0.select(*by("_b0", "_b1"), before(l0, by("_b1"), ["_b0"], "_v0").alias("_o0"))
    l0 = join(l0, l1, "_b1").select(*by("_b0"), (F.col("_o0") + F.col("_o1")).alias("_o0"))
    low = low.withColumn("_o", before(low, by("_b0"), [F.col(order).asc_nulls_first(), *ties], value))
    return join(low, l0, "_b0").withColumn(out, F.col("_o") + F.col("_o0")).drop("_b0", "_o", "_o0")


# ----------------------------------------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every node of the undirected edges (a, b): the smallest id that it reaches.

    Alternating large-star and small-star steps, each an aggregation with map-side combine and a join back (which
    adaptive execution splits where skewed); after each pair of steps the edges are written to the shared folder. The steps
    go on until nothing changes; their number grows with the logarithm of the number of nodes.
    """
    spark = edges.sparkSession
    cur = write_shared(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def seal(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last, mark = None, seal(cur)
    if mark[0]:
        while mark != last:
            both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a")
            small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("a", F.col("m").alias("b")))
            cur = write_shared(small.distinct())
            mark, last = seal(cur), mark
    tops = cur.groupBy("a").agg(F.min("b").alias("component_id")).withColumnRenamed("a", "id")
    return tops.union(cur.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())


# ------------------------------------------------------------------------------- words over Arrow text buffers
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


#: Odd multipliers and a start value per lane; hashes of different lanes are independent of each other.
_LANES = [tuple(_U(x) for x in three) for three in ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0x165667B19E3779F9))]
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 64


def joined(x: np.ndarray, y: np.ndarray, lane: int) -> np.ndarray:
    """A hash of pairs of hashes. Every step is mixed, so no algebra of longer sequences carries over."""
    a, b, c = _LANES[lane]
    return mix(mix(x * a + c) + y * b)


def windows(words: np.ndarray, length: int, lane: int) -> np.ndarray:
    """A hash of every window of `length` words, by doubling: a window is told by two shorter ones that cover it."""
    h, size = words, 1
    if len(words) < length:
        return words[:0]
    while size < length:
        step = min(size, length - size)
        h = joined(h[:-step], h[step:], lane)
        size += step
    return h


def sequences(words: np.ndarray, first: np.ndarray, lane: int) -> np.ndarray:
    """A hash of each whole sequence words[first[i]:first[i + 1]]: sums of words mixed with their places in it."""
    place = (np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(joined(words, mix(place + _LANES[lane][2]), lane), out=total[1:])
    return joined(total[first[1:]] - total[first[:-1]], np.diff(first).astype(np.uint64), lane)


class Texts:
    """A slice of documents: raw bytes, byte offsets, word bounds, and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int, fold: bool, space: np.ndarray = SPACE):
        self.first_row, self.n = first_row, len(offsets) - 1
        self.offsets = offsets
        self.data = LOWER[data] if fold else data
        inside = ~space[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def eight(self) -> np.ndarray:
        """At every place of data, the eight bytes from there on as one little-endian number."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        return np.ndarray(len(self.data) + 1, "<u8", padded.data, strides=(1,))

    def words(self, lane: int = 0) -> np.ndarray:
        """A hash of every word: eight bytes a step, each step mixed; long words by a digest."""
        eight, lengths = self.eight(), self.ends - self.starts
        h = mix(lengths.astype(np.uint64) + _LANES[lane][2])
        live = np.flatnonzero(lengths <= LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            live = live[lengths[live] > at]
            if not len(live):
                break
            h[live] = joined(h[live], eight[self.starts[live] + at] & FIRST_BYTES[np.minimum(lengths[live] - at, 8)], lane)
        for i in np.flatnonzero(lengths > LONG_WORD):
            digest = hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=16).digest()
            h[i] = np.frombuffer(digest, "<u8")[lane]
        return h


def buffers(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Cuts a text column into slices of whole documents of about SLICE_BYTES: bytes, offsets from 0, first row; nulls read as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        to = min(to, len(col))
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at
        at = to


def slices(col: pa.Array, fold: bool = False, space: np.ndarray = SPACE) -> Iterator[Texts]:
    """A text column as slices of whole documents of about SLICE_BYTES."""
    for data, offsets, at in buffers(col):
        yield Texts(data, offsets, at, fold, space)


# ------------------------------------------------------------------------------------------------ tokenisation
#: Where the public vocabulary files are; a parameter of every operator that tokenises.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Byte-level symbols: bytes without a printable character stand for 256, 257 and so on, in order.
_SYMBOLS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class Table:
    """Ids of byte strings of 1 to 24 bytes without NUL, looked up in bulk: open addressing by rows of three words of eight
    bytes, which hold the whole string (no two are taken for each other), and the place and number of its ids in a pool."""

    def __init__(self, bits: int = 16):
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.rows = np.zeros((1 << bits, 4), np.uint64)
        self.pool, self.n, self.used = np.zeros(1 << 16, np.uint32), 0, 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        a, b, c = _LANES[0]
        h = keys[:, 0] * a ^ keys[:, 1] * b ^ keys[:, 2] * c
        return ((h ^ h >> _U(32)) * b >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """place << 8 | number of each key, 0 where it is not held."""
        out, at, slots = np.zeros(len(keys), np.int64), None, self._slots(keys)
        while True:
            rows = self.rows[slots]
            same = (rows[:, 0] == keys[:, 0]) & (rows[:, 1] == keys[:, 1]) & (rows[:, 2] == keys[:, 2])
            if at is None:
                out = np.where(same, rows[:, 3], 0).astype(np.int64)
            else:
                out[at[same]] = rows[same, 3]
            on = np.flatnonzero(~same & (rows[:, 0] != 0))
            if not len(on):
                return out
            at, keys, slots = on if at is None else at[on], keys[on], slots[on] + 1 & self.mask

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct keys that are not held, with their ids one after the other."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        rows = np.column_stack([keys, ((self.used + np.cumsum(counts) - counts) << 8 | counts).astype(np.uint64)])
        self.used, self.n = self.used + len(ids), self.n + len(keys)
        if 2 * self.n > len(self.rows):
            rows = np.concatenate([self.rows[self.rows[:, 0] != 0], rows])
            bits = (2 * self.n).bit_length()
            self.shift, self.mask, self.rows = _U(64 - bits), (1 << bits) - 1, np.zeros((1 << bits, 4), np.uint64)
        slots = self._slots(rows)
        while len(rows):
            free = np.flatnonzero(self.rows[slots, 0] == 0)
            took = free[np.unique(slots[free], return_index=True)[1]]
            self.rows[slots[took]] = rows[took]
            rest = np.ones(len(rows), bool)
            rest[took] = False
            rows, slots = rows[rest], slots[rest] + 1 & self.mask


#: Kinds of bytes for the tokenizer's splitter.
LETTER, DIGIT, MARK, BLANK, LINE, OTHER = range(6)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127], KIND[48:58], KIND[65:91], KIND[97:123], KIND[32], KIND[10] = MARK, DIGIT, LETTER, LETTER, BLANK, LINE
#: First bytes of letters of two bytes: U+00C0 to U+023F (but for U+00D7 and U+00F7) and U+0400 to U+047F.
TWO = np.isin(np.arange(256), (*range(0xC3, 0xC9), 0xD0, 0xD1))
#: First bytes of the characters among which white space beyond ASCII is, by their number of bytes.
WIDE2, WIDE3 = np.isin(np.arange(256), 0xC2), np.isin(np.arange(256), (0xE1, 0xE2, 0xE3))


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizers library's own.

    Byte-level BPE never merges across a single space that stands between two other characters, so texts are cut into
    pieces at such spaces. A piece of letters (ASCII and those of `TWO`), digits, marks and single line ends is cut further
    where the library's splitter cuts: between these kinds. Such parts are looked up in a table, a slice of texts at a time, and
    encoded once by the library; the table is emptied when full. Other pieces (other characters, contractions, further white
    space) and parts of over 24 bytes are encoded whole by the library, and kept by their bytes where they are short.
    """

    #: Parts in the table, other pieces kept.
    ROOM, ODD = 1 << 20, 100_000

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.library.encode_special_tokens = True
        n = max(self.library.get_vocab().values()) + 1
        #: Tokens that begin with a space.
        self.led = np.array([(self.library.id_to_token(i) or "").startswith(chr(_SYMBOLS[32])) for i in range(n)])
        self.table: Table = Table()
        self.odd: dict[bytes, list[int]] = {}

    @classmethod
    def get(cls, vocabulary: str = VOCABULARY) -> Encoder:
        """The encoder of this Python worker, which keeps its table from task to task."""
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = cls(vocabulary)
        return _ENCODERS[vocabulary]

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the parts of a slice start, their lengths, and whether each is known to be one part of the library's splitter."""
        n = len(data)
        kind = KIND[data]
        two = np.flatnonzero(TWO[data])
        two = two[(data[two] != 0xC3) | (data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
        kind[two] = kind[two + 1] = LETTER
        first = np.zeros(n + 1, bool)
        first[offsets] = True

        def tight(at: np.ndarray) -> np.ndarray:
            """Whether both neighbours are there and no white space or control characters."""
            before, after = data[at - 1], data[np.minimum(at + 1, n - 1)]
            ok = ~first[at] & ~first[at + 1] & (before > 32) & (after > 32) & ~WIDE2[after] & ~WIDE3[after]
            return ok & ~((before >= 128) & (WIDE2[data[np.maximum(at - 2, 0)]] | WIDE3[data[np.maximum(at - 3, 0)]]))

        blank, line = np.flatnonzero(kind == BLANK), np.flatnonzero(kind == LINE)
        quote = np.flatnonzero(data == 0x27)
        safe = tight(blank)
        edge = first[:n].copy()
        edge[blank[safe]] = True
        bad = np.concatenate([np.flatnonzero(kind == OTHER), blank[~safe], line[~tight(line)], quote[kind[np.minimum(quote + 1, n - 1)] == LETTER]])
        pieces = np.flatnonzero(edge) if len(bad) else None
        edge[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK)
        plain = None
        if len(bad):
            hit = np.unique(np.searchsorted(pieces, bad, "right") - 1)
            step = np.zeros(n + 1, np.int8)
            step[pieces[hit]] += 1
            step[np.append(pieces, n)[hit + 1]] -= 1
            inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
            edge &= ~inside
            edge[pieces[hit]] = True
            plain = ~inside
        starts = np.flatnonzero(edge)
        lengths = np.diff(starts, append=n)
        return starts, lengths, (lengths <= 24) if plain is None else (lengths <= 24) & plain[starts]

    def _learn(self, keys: np.ndarray, data: bytes, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Adds parts to the table. Words after a space are encoded as one text, whose tokens that begin with a space begin them."""
        parts = [data[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())]
        word = np.array([x[0] == 32 and (TWO[x[1]] or KIND[x[1]] == LETTER) for x in parts])
        ids = np.array(self._ids([b"".join(x for x, w in zip(parts, word) if w)])[0], np.uint32)
        at = np.flatnonzero(self.led[ids])
        if len(at) == word.sum():
            self.table.add(keys[word], ids, np.diff(at, append=len(ids)))
        else:
            word[:] = False
        rest = self._ids([x for x, w in zip(parts, word) if not w])
        self.table.add(keys[~word], np.array([i for x in rest for i in x], np.uint32), np.array([len(x) for x in rest], np.int64))

    def _whole(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces by the library alone."""
        if len(self.odd) > self.ODD:
            self.odd.clear()
        new = list({x for x in pieces if x not in self.odd})
        found = dict(zip(new, self._ids(new)))
        self.odd.update((x, ids) for x, ids in found.items() if len(x) <= 64)
        return [found[x] if x in found else self.odd[x] for x in pieces]

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        if not len(data):
            return [b""] * (len(offsets) - 1)
        if self.table.n > self.ROOM:
            self.table = Table()
        raw = data.tobytes()
        starts, lengths, plain = self._parts(data, offsets)
        padded = np.frombuffer(raw + bytes(32), np.uint8)
        eight = np.ndarray(len(data) + 25, "<u8", padded.data, strides=(1,))
        keys = np.zeros((len(starts), 3), np.uint64)
        keys[:, 0] = eight[starts] & FIRST_BYTES[np.minimum(lengths, 8)]
        for k in (1, 2):
            on = np.flatnonzero(plain & (lengths > 8 * k))
            keys[on, k] = eight[starts[on] + 8 * k] & FIRST_BYTES[np.minimum(lengths[on] - 8 * k, 8)]
        where = self.table.find(keys)
        where[~plain] = 0
        miss = np.flatnonzero((where == 0) & plain)
        if len(miss):
            new, one = np.unique(np.ascontiguousarray(keys[miss]).view("V24").ravel(), return_index=True)
            one = miss[one]
            self._learn(keys[one], raw, starts[one], lengths[one])
            where[miss] = self.table.find(keys[miss])
        counts, places, odd = where & 255, where >> 8, np.flatnonzero(~plain)
        own, before = counts[plain], np.cumsum(counts[plain]) - counts[plain]
        ids = self.table.pool[np.repeat(places[plain] - before, own) + np.arange(own.sum())]
        if len(odd):
            whole = self._whole([raw[a : a + n] for a, n in zip(starts[odd].tolist(), lengths[odd].tolist())])
            counts[odd] = [len(x) for x in whole]
            known, of_table = np.repeat(plain, counts), ids
            ids = np.empty(len(known), np.uint32)
            ids[known], ids[~known] = of_table, [i for x in whole for i in x]
        upto = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)] * 4
        out = ids.astype("<u4", copy=False).tobytes()
        return [out[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        return [x for data, offsets, _ in buffers(col) for x in self._slice(data, offsets)]


_ENCODERS: dict[str, Encoder] = {}
