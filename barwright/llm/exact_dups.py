"""Exact dedup by Grace hashing.

* Each task first groups the texts that it reads in an open-addressing table, so a text that is copied within a task
  travels once, with the ids of its rows. These records are the unit of all that follows.
* The records are partitioned by hash into spill files: one bucket a file, written by Spark as a bucketed table in the shared
  folder. Buckets whose distinct texts do not fit a table of `room` bytes are partitioned again by other bits of the
  hash, into new files, until each fits; a bucket of one hash fits whatever its size, as the table reads records as a
  stream and holds each distinct text once.
* Each bucket is read (without a shuffle) into an open-addressing table that compares complete contents, which gives every
  record the largest id and the number of rows of its text. The ids are then joined to that by record.

No step gathers the rows of one text: a record holds at most `RECORD_IDS` ids, records are keyed by their own number, and
a text that a third of all rows share counts as one record a task in its bucket. Lost tasks read the files again.

Edge cases: null counts as empty and equals it; texts are equal when identical after no change; of equal texts the row with the
largest doc_id stays, a null id being smaller than all others; of rows that repeat both id and text exactly one is marked
as kept; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, table, write_shared

#: Bytes of distinct texts that a table may hold, in a task's first grouping and in a bucket.
ROOM = 32 << 20
#: Buckets of one level at most; more data takes a further level.
FAN_OUT = 4_096
RECORD_IDS = 4_096
_NONE = -(2**63)


class ContentTable:
    """Open addressing with linear probing: slots hold entry numbers, entries their hash and complete content."""

    def __init__(self, slots: int = 1 << 10):
        self.mask, self.slots = slots - 1, [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for entry, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = at + 1 & self.mask
            self.slots[at] = entry

    def entry(self, h: int, content: bytes) -> int:
        """The number of the entry with this content, which is added where it is new."""
        at = h & self.mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            at = at + 1 & self.mask
        e = self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.hashes) > self.mask:
            self._grow()
        return e


RECORDS = "rec long, h long, text string, bytes long, ids array<bigint>, n long, top long"


def local_records(docs: DataFrame, room: int = ROOM) -> DataFrame:
    """Rows grouped within each task: rec (a number of its own), h, text, ids, n and the largest id of each record."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        seen, ids = ContentTable(), []

        def records(of: list[int]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for at in range(0, len(of), 256):
                some = of[at : at + 256]
                own = [ids[e] for e in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(number, number + len(some)), pa.int64()), pa.array([seen.hashes[e] for e in some], pa.int64()), pa.array([seen.contents[e] for e in some], pa.binary()).cast(pa.string()),
                     pa.array([len(seen.contents[e]) for e in some], pa.int64()), pa.array(own, pa.list_(pa.int64())), pa.array([len(x) for x in own], pa.int64()), pa.array([max(map(known, x)) for x in own], pa.int64())],
                    names=["rec", "h", "text", "bytes", "ids", "n", "top"],
                )
                number += len(some)

        for batch in batches:
            for doc_id, content, h in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                e = seen.entry(h, content)
                if e == len(ids):
                    ids.append([])
                ids[e].append(doc_id)
                if len(ids[e]) == RECORD_IDS:
                    yield from records([e])
                    ids[e] = []
            if seen.bytes > room:
                yield from records([e for e, x in enumerate(ids) if x])
                seen, ids = ContentTable(), []
        yield from records([e for e, x in enumerate(ids) if x])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(group, RECORDS)


def known(doc_id: int | None) -> int:
    return _NONE if doc_id is None else doc_id


def spill(records: DataFrame, buckets: int) -> DataFrame:
    """records written to the shared folder, one file for each value range of `bucket`; a bucketed table, so that readers that
    group by bucket need no shuffle. The catalogue's name is given up at once, the files stay."""
    spark = records.sparkSession
    name, files = f"barwright_{uuid.uuid4().hex}", max(1, min(buckets, FAN_OUT))
    writer = records.repartition(files, "bucket").write.format("parquet").bucketBy(files, "bucket")
    writer.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"drop table {name}")
    return written


def bucket_of(level: int, buckets: int):
    """Another part of the hash at every level."""
    return F.pmod(F.xxhash64("h", F.lit(level)), F.lit(buckets))


def partitioned(records: DataFrame, size: int, room: int = ROOM, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """The spill tables of all levels, each reduced to its buckets that fit."""
    buckets = max(1, min(fan_out, -(-2 * size // room)))
    todo, level, done = records.withColumn("bucket", bucket_of(0, buckets)), 0, []
    while True:
        files = spill(todo, buckets)
        held = files.groupBy("bucket", "h").agg(F.max("bytes").alias("bytes"))
        held = held.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("texts"))
        large = write_shared(held.where((F.col("bytes") > room) & (F.col("texts") > 1)).select("bucket", F.ceil(F.lit(2) * F.col("bytes") / room).alias("parts")))
        sums = large.agg(F.count("*"), F.sum("parts")).first()
        if not sums[0]:
            return [*done, files]
        done.append(files.join(large, "bucket", "left_anti"))
        level, buckets = level + 1, int(sums[1])
        parts = F.least("parts", F.lit(fan_out))
        todo = files.join(large, "bucket").withColumn("bucket", F.xxhash64("bucket", F.pmod(F.xxhash64("h", F.lit(level)), parts))).drop("parts")


def grouped(files: DataFrame) -> DataFrame:
    """rec, keep_id, group_size, keeper (the record that holds the row to keep) of every record, bucket by bucket."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, of, recs = ContentTable(), [], []
        top, size, best = [], [], []
        for batch in batches:
            for rec, h, content, n, most in zip(*(batch.column(c).to_pylist() for c in ("rec", "h")), batch.column("text").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in ("n", "top"))):
                e = seen.entry(h, content)
                if e == len(top):
                    top.append(most)
                    size.append(0)
                    best.append(rec)
                if (most, -rec) > (top[e], -best[e]):
                    top[e], best[e] = most, rec
                size[e] += n
                of.append(e)
                recs.append(rec)
        of = np.array(of, np.int64)
        rec, keep, size, best = (np.array(x, np.int64) for x in (recs, top, size, best))
        yield pa.RecordBatch.from_arrays([pa.array(rec), pa.array(keep[of], mask=keep[of] == _NONE), pa.array(size[of]), pa.array(best[of] == rec)], names=["rec", "keep_id", "group_size", "keeper"])

    return files.select("bucket", "rec", "h", "text", "n", "top").groupBy("bucket").applyInArrow(look, "rec long, keep_id long, group_size long, keeper boolean")


def exact_groups(docs: DataFrame, room: int = ROOM, fan_out: int = FAN_OUT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = members = None
    for files in partitioned(local_records(docs, room), size, room, fan_out):
        one = grouped(files)
        groups = one if groups is None else groups.union(one)
        own = files.select("rec", "ids", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
        members = own if members is None else members.union(own)
    # the place of the row to keep is found before the ids are spread, so that no row carries its record's list
    first = F.when(~F.col("keeper"), F.lit(0)).when(F.col("keep_id").isNull(), F.lit(1)).otherwise(F.array_position("ids", F.col("keep_id"))) - 1
    rows = members.join(groups, "rec").select("keep_id", "group_size", "text_sha256", "ids", first.alias("first"))
    rows = rows.select("keep_id", "group_size", "text_sha256", "first", F.posexplode("ids").alias("place", "doc_id"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("first")).alias("kept"), "text_sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


#: The same groups for DuckDB, by whole texts.
OP12_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
