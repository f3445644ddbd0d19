"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct k-word shingles; two documents link when their Jaccard similarity reaches the
threshold t. Shingles are ordered rare class first, then by how many documents they are in (in steps of a factor of
sqrt 2), then by hash. The frequent class are the shingles in more than `often` documents, at most `room` of them, the
most frequent ones; any other division of the shingles would give the same links. Counts are exact over all documents
(modulo hash collisions, which only make a shingle more frequent).
With n shingles, a document indexes

* its first floor((1 - t) n) + 1 rare shingles, singly, if it has that many: a partner misses at most floor((1 - t) n);
* else all its rare shingles singly, and the prefix is extended to floor(2 (1 - t) n) + 2 frequent shingles, which are
  indexed as combinations of two that are neighbours in the order. Linked documents that share no rare shingle still
  share such a pair: each missing shingle breaks at most two neighbourhoods and each additional one at most one,
  2 (1 - t) n altogether.

Documents with equal sets are one class, represented by the smallest doc_id; only representatives are joined. The list of
a shingle in at most `often` documents yields all its pairs of fitting sizes. All other lists may be of any length: every
document of such a list meets the list's head. Once these pairs are verified, a list's documents outside of its largest
component meet the head of their own; only those that are left outside after that are compared with the whole list, by
size and sketch, in parts of at most `part` documents. So no list is expanded into its pairs, and components are exact.
Pairs are ruled out by a parity sketch (every shingle in which two sets differ flips one bit, so sketches differ in no
more bits than the sets do in shingles), then by their prefixes; the rest is verified on the whole texts.

Edge cases: null and empty texts have no shingle and link with nothing; shorter texts than k words have one, the whole
sequence; rows that repeat an id are one node to links (`drop_near_copies` tells them apart by their texts); null ids take
no part in links and have a null component; an empty table gives an empty result; extra columns are not read
(`drop_near_copies` passes them through).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, mix, prefix_sum, slices, table, write_shared

#: The most shingles that are indexed in combination; all others are indexed singly, whatever their frequency.
FREQUENT_ROOM = 1 << 20
#: Shingles of one range of hashes, which are counted together, and documents of a list that are compared in one go.
RANGE, PART = 1 << 22, 4096
#: Bits of the parity sketch.
SKETCH = 512
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes) of each text."""
    for t in slices(texts, fold=True):
        w = t.words()
        m = max(len(w) - k + 1, 0)
        grams = np.full(m, _C)
        for i in range(k):
            grams = mix(grams * _A + w[i : i + m] * _B)
        bounds = t.first.tolist()
        for d in range(t.n):
            lo, hi = bounds[d], bounds[d + 1]
            if hi - lo >= k:
                s = np.sort(grams[lo : hi - k + 1])
                s = s[np.append(True, s[1:] != s[:-1])]
            elif hi > lo:
                h = np.full(1, hi - lo, np.uint64) * _C
                for i in range(lo, hi):
                    h = mix(h * _B + w[i : i + 1] * _A)
                s = h
            else:
                s = w[:0]
            yield t.first_row + d, s


def range_keys(s: np.ndarray, ranges: int) -> np.ndarray:
    """The key under which shingles are counted: the range of the hash's high half, then its low half."""
    return ((s >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)) << np.uint64(32) | s & np.uint64(0xFFFFFFFF)


def count_shingles(docs: DataFrame, k: int, often: int) -> tuple[DataFrame, int]:
    """(key, df) of the shingles in more than `often` documents, and the number of ranges of hashes.

    Tasks count their own shingles and send the counts, packed per range of hashes; every range is added up by itself. There
    is one range for each RANGE bytes of text, so no range has more than about RANGE distinct shingles, however many
    documents there are; a shingle that is everywhere adds one number a task to its range.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            own, at = np.unique(h >> np.uint64(32), return_index=True)
            h, one, n = h.astype("<u4"), n == 1, n.astype("<u4")
            some = [(int(r), h[s:e][one[s:e]].tobytes(), h[s:e][~one[s:e]].tobytes(), n[s:e][~one[s:e]].tobytes()) for r, s, e in zip(own, at, [*at[1:], len(h)])]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["range", "single", "many", "n"])

        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                if len(s):
                    parts.append(range_keys(s, ranges))
                    held += len(s)
                    if held > 1 << 21:
                        yield packed()
                        parts, held = [], 0
        if parts:
            yield packed()

    def add(t: pa.Table) -> pa.Table:
        joined = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist()), "<u4")
        h, n = np.unique(joined("single"), return_counts=True)
        h, at = np.unique(np.concatenate([h, joined("many")]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, joined("n")])).astype(np.int64)
        key = np.uint64(t.column("range")[0].as_py()) << np.uint64(32) | h[n > often].astype(np.uint64)
        return pa.table({"key": key.astype(np.int64), "df": n[n > often]})

    sums = docs.select("text").mapInArrow(count, "range long, single binary, many binary, n binary")
    # a task adds up some four ranges, whatever the session's number of shuffle partitions
    return write_shared(sums.repartition(max(1, ranges // 4), "range").groupBy("range").applyInArrow(add, "key long, df long")), ranges


def frequent_shingles(counted: DataFrame, room: int = FREQUENT_ROOM) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys of the frequent class (at most `room`, whole steps of frequency from the top), their steps (0 to 63),
    and the least df of that class."""
    step = F.floor(F.log2("df") * 16)
    total, least = 0, 1 << 62
    for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("df").alias("least")).orderBy(F.desc("step")).collect():
        total += r["n"]  # at most 16 x 64 rows
        if total > room:
            break
        least = r["least"]
    rows = counted.where(F.col("df") >= least).toPandas()  # at most `room` rows
    key = rows["key"].to_numpy().astype(np.uint64)
    order = np.argsort(key)
    steps = np.minimum(np.floor(2 * np.log2(rows["df"].to_numpy().astype(np.float64))), 63).astype(np.uint8)
    return key[order], steps[order], least


def signatures(docs: DataFrame, k: int, t: Fraction, frequent: np.ndarray, steps: np.ndarray, ranges: int) -> DataFrame:
    """doc_id, n_shingles, the set's key (k1, k2), its single and its paired signatures, the prefix of the latter, and the
    set's parity sketch. Frequent shingles stand as keys that sort by step of frequency, then by hash."""
    maybe = np.zeros(1 << 22, bool)
    maybe[(frequent & np.uint64(0x3FFFFF)).astype(np.int64)] = True

    def split(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rare shingles and the sorted keys of the frequent ones."""
        h = range_keys(s, ranges)
        out = maybe[(h & np.uint64(0x3FFFFF)).astype(np.int64)]
        at = np.flatnonzero(out)
        if not len(at):
            return s, s[:0]
        i = np.minimum(np.searchsorted(frequent, h[at]), len(frequent) - 1)
        true = frequent[i] == h[at]
        out[at] = true
        return s[~out], np.sort(steps[i[true]].astype(np.uint64) << np.uint64(58) | s[at[true]] >> np.uint64(6))

    def sketch(s: np.ndarray) -> np.ndarray:
        odd = np.bincount((mix(s ^ _A) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                n, k1, k2, single, pairs, prefix, bits = [], [], [], [], [], [], []
                for _, s in shingle_sets(some.column(1), k):
                    n.append(len(s))
                    k1.append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    k2.append(int(mix(s ^ _C).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    miss = math.floor((1 - t) * len(s))
                    rare, often_ = split(s)
                    if len(rare) > miss:
                        single.append(rare[: miss + 1].view(np.int64))
                        pairs.append(none)
                        prefix.append(none)
                    else:
                        f = often_[: math.floor(2 * (1 - t) * len(s)) + 2]
                        single.append(rare.view(np.int64))
                        prefix.append(f.view(np.int64))
                        # a prefix that is one shingle has no neighbour: it stands for itself
                        pairs.append((mix(f[:-1] * _A + f[1:] * _B) if len(f) > 1 else f).view(np.int64))
                    bits.append(sketch(s) if len(s) else none)
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(single, lists), pa.array(pairs, lists), pa.array(prefix, lists), pa.array(bits, lists)], names=["doc_id", "n_shingles", "k1", "k2", "single", "pairs", "prefix", "bits"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, k1 long, k2 long, single array<bigint>, pairs array<bigint>, prefix array<bigint>, bits array<bigint>")


def plausible(pairs: DataFrame, reps: DataFrame, t: Fraction) -> DataFrame:
    """The pairs whose prefixes do not rule them out: up to the shorter prefix's end, the two sets may differ in no more
    shingles than the whole sets may."""
    side = lambda x: reps.select(F.col("doc").alias(x), F.struct("n", "single", "prefix").alias(f"s{x}"))

    def differ(x: np.ndarray, y: np.ndarray, end: int | None) -> int:
        if end is not None:
            x, y = x[x <= end], y[y <= end]
        both = np.sort(np.concatenate([x, y]))
        return len(both) - 2 * int((both[1:] == both[:-1]).sum())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            sides = [batch.column(i) for i in (2, 3)]
            n = [c.field("n").to_pylist() for c in sides]
            rare = [[np.asarray(x.values).view(np.uint64) for x in c.field("single")] for c in sides]
            often = [[np.asarray(x.values).view(np.uint64) for x in c.field("prefix")] for c in sides]
            for i in range(len(batch)):
                (na, nb), (ra, rb), (fa, fb) = ((x[0][i], x[1][i]) for x in (n, rare, often))
                least = math.ceil(t * (na + nb) / (1 + t))
                ends = [r[-1] for r, f in ((ra, fa), (rb, fb)) if not len(f)]
                d = differ(ra, rb, min(ends) if ends else None)
                if len(fa) and len(fb):
                    d += differ(fa, fb, min(fa[-1], fb[-1]))
                good.append(d <= na + nb - 2 * least)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold."""
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null and text is not null")
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [s for _, s in shingle_sets(batch.column(2), k)]
            good = []
            for (_, y), s in zip(shingle_sets(batch.column(3), k), x):
                inter = len(s) + len(y) - len(np.unique(np.concatenate([s, y])))
                good.append(bool(inter) and t.denominator * inter >= t.numerator * (len(s) + len(y) - inter))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long").distinct()


def jaccard_classes(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5), often: int = 16, room: int = FREQUENT_ROOM, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (the key of the set) and component_id of every row: the smallest doc_id that its links
    reach."""
    t = threshold
    counted, ranges = count_shingles(docs, k, often)
    frequent, steps, least = frequent_shingles(counted, room)
    signed = write_shared(signatures(docs, k, t, frequent, steps, ranges))
    key = ["n_shingles", "k1", "k2"]
    # different sets can only link if both have t / (1 - t) shingles
    reps = signed.where("n_shingles > 0 and doc_id is not null").where(F.col("n_shingles") >= math.ceil(t / (1 - t)))
    reps = reps.groupBy(*key).agg(F.min_by(F.struct("doc_id", "single", "pairs", "prefix", "bits"), "doc_id").alias("r"))
    reps = write_shared(reps.select(F.col("r.doc_id").alias("doc"), F.col("n_shingles").alias("n"), "r.single", "r.pairs", "r.prefix", "r.bits"))
    fits = lambda x, y: F.least(x, y) * t.denominator >= F.greatest(x, y) * t.numerator

    def alike(x: str, y: str) -> Column:
        """Whether sizes and sketches leave room for a link: D differing shingles need D (1 + t) <= (n + m) (1 - t)."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        words = [F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(SKETCH // 64)]
        differ = sum(words[1:], words[0])
        return fits(n, m) & (differ * (t.denominator + t.numerator) <= (n + m) * (t.denominator - t.numerator))

    single = reps.select(F.explode("single").alias("sig"), "doc", "n")
    # single shingles above `often` for which the frequent class has no room: none, but in tables of extreme size
    high = F.shiftrightunsigned("sig", 32)
    at = (F.shiftrightunsigned(high * ranges, 32) * F.lit(1 << 32)).bitwiseOR(F.col("sig").bitwiseAND(0xFFFFFFFF))
    crowded = counted.where(F.col("df") < least).select("key")
    spare = not crowded.isEmpty()
    short = single.withColumn("key", at).join(crowded, "key", "left_anti") if spare else single
    lists = short.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("doc", "n"))).alias("l")).where(F.size("l") > 1)  # at most `often` each
    rest = lists.select("l", F.posexplode("l").alias("i", "x")).select("x", F.explode(F.slice("l", F.col("i") + 2, F.lit(1 << 30))).alias("y"))
    rare = rest.where(fits(F.col("x.n"), F.col("y.n"))).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))

    side = F.struct("doc", "n", "bits").alias("d")
    members = reps.where(F.size("pairs") > 0).select(F.explode(F.array_distinct("pairs")).alias("sig"), side)
    if spare:
        members = members.union(reps.select(F.explode("single").alias("sig"), side).withColumn("key", at).join(crowded, "key", "left_semi").select("sig", "d"))
    members = write_shared(members)
    salt = F.pmod(F.xxhash64("d.doc"), F.lit(16))

    def met(some: DataFrame) -> DataFrame:
        """The pairs of each list's documents with its head, the one with the smallest id."""
        heads = some.groupBy("sig", salt.alias("salt")).agg(F.min_by("d", "d.doc").alias("h")).groupBy("sig").agg(F.min_by("h", "h.doc").alias("h"))
        heads = heads.select(F.col("sig").alias("sig_"), "h")
        both = some.join(heads, (F.col("sig") == F.col("sig_")) & (F.col("d.doc") != F.col("h.doc")) & alike("d", "h"))
        return both.select(F.least("d.doc", "h.doc").alias("a"), F.greatest("d.doc", "h.doc").alias("b"))

    def outside(some: DataFrame, reach: DataFrame) -> DataFrame:
        """The documents of each list that are not in the component that holds most of it, with the list's length."""
        placed = some.join(reach.withColumnRenamed("id", "id_"), F.col("d.doc") == F.col("id_"), "left").select("sig", "d", F.coalesce("component_id", "d.doc").alias("c"))
        sizes = placed.groupBy("sig", "c").agg(F.count("*").alias("size"))
        top = sizes.groupBy("sig").agg(F.max_by("c", F.struct("size", "c")).alias("top"), F.sum("size").alias("length")).withColumnRenamed("sig", "sig_")
        return placed.join(top, (F.col("sig") == F.col("sig_")) & (F.col("c") != F.col("top"))).select("sig", "d", "c", "length")

    def across(some: DataFrame, out: DataFrame, reach: DataFrame) -> DataFrame:
        """The pairs of documents that are out with all of their list in other components."""
        placed = some.join(reach.withColumnRenamed("id", "id_"), F.col("d.doc") == F.col("id_"), "left").select(F.col("sig").alias("sig_"), F.col("d").alias("e"), F.coalesce("component_id", "d.doc").alias("c_"))
        # a list of any length is dealt into parts, and each document that is out visits all of them
        parts = F.greatest(F.lit(1), F.ceil(F.col("length") / part)).cast("int")
        lengths = out.groupBy("sig").agg(F.first("length").alias("length")).select(F.col("sig").alias("of"), parts.alias("parts"))
        placed = placed.join(lengths, F.col("sig_") == F.col("of")).withColumn("part_", F.pmod(F.xxhash64("e.doc"), F.col("parts")).cast("int"))
        out = out.select("sig", "d", "c", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        both = out.join(placed, (F.col("sig") == F.col("sig_")) & (F.col("part") == F.col("part_")) & (F.col("c") != F.col("c_")) & alike("d", "e"))
        return both.select(F.least("d.doc", "e.doc").alias("a"), F.greatest("d.doc", "e.doc").alias("b"))

    def links(pairs: DataFrame, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The new pairs and those of them that link."""
        pairs = pairs.where("a < b").distinct()
        pairs = write_shared(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        return pairs, write_shared(verified(write_shared(plausible(pairs, reps, t)), docs, k, t))

    def widened(reach: DataFrame, found: DataFrame) -> DataFrame:
        """The components after further links, found among the components before."""
        if found.isEmpty():
            return reach
        of = lambda x: F.coalesce(f"c{x}", x).alias(x)
        now = found
        for x in "ab":
            now = now.join(reach.withColumnsRenamed({"id": f"id{x}", "component_id": f"c{x}"}), F.col(x) == F.col(f"id{x}"), "left")
        joined = components(now.select(of("a"), of("b")))
        new = joined.select(F.col("id").alias("old"), F.col("component_id").alias("new"))
        moved = reach.join(new, F.col("component_id") == F.col("old"), "left").select("id", F.coalesce("new", "component_id").alias("component_id"))
        # documents that had no link before stand as components of themselves
        return write_shared(moved.union(joined.join(reach, "id", "left_anti")))

    tried, found = links(rare.union(met(members)), None)
    reach = write_shared(components(found))
    out = write_shared(outside(members, reach))
    if not out.isEmpty():
        pairs, found = links(met(out.select("sig", "d")), tried)
        tried, reach = tried.union(pairs), widened(reach, found)
        out = write_shared(outside(members, reach))
        pairs, found = links(across(members, out, reach), tried)
        reach = widened(reach, found)

    # rows that repeat an id with different sets are one node: it links to the classes of all its rows
    classes = write_shared(signed.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep")))
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).where("x <> y").select("doc_id")
    several = write_shared(signed.join(several, "doc_id", "left_semi").select("doc_id", *key))
    reach = widened(reach, several.join(classes, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b"))
    component = reach.select(F.col("id").alias("rep"), "component_id")
    classes = classes.join(component, "rep", "left").select(*key, F.coalesce("component_id", "rep").alias("of_set"))
    nodes = several.select(F.col("doc_id").alias("rep")).distinct().join(component, "rep", "left").select(F.col("rep").alias("doc_id"), F.coalesce("component_id", "rep").alias("of_node"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_node", F.when(F.col("n_shingles") > 0, F.col("of_set")), "doc_id"))
    return signed.select("doc_id", *key).join(classes, key, "left").join(nodes, "doc_id", "left").select("doc_id", *key, own.alias("component_id"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each component of docs, with all columns: the one with the smallest doc_id. Rows that repeat an id with another
    text are documents of their own (the one whose text has the smaller hash comes first), with the same text one document;
    rows with a null id stay."""
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        gone = jaccard_classes(docs, **options).where("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # ids that repeat: documents are numbered in the order of their ids
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"))
    pairs = rows.where("id is not null").select("id", "h").distinct().withColumn("one", F.lit(1))
    ranked = prefix_sum(pairs, [], "id", "one", "rank", ties=["h"]).select("id", "h", "rank")
    named = rows.join(ranked, ["id", "h"], "left").withColumn("k", F.row_number().over(Window.partitionBy("id", "h").orderBy(F.lit(0))))
    named = write_shared(named.where("id is null or k = 1").select("row", F.col("rank").alias("doc_id"), F.col("row.text").alias("text")))
    gone = jaccard_classes(named, **options).where("component_id <> doc_id").select("doc_id")
    return named.join(gone, "doc_id", "left_anti").select("row.*")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(table(spark, sf_dir, "documents"), k=3, threshold=Fraction(9, 10))
    return found.select("doc_id", "n_shingles", "component_id")
