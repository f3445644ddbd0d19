"""Token-id files of directly addressable codes.

Format. A file row is one shard of consecutive documents: `n_tokens`, `doc_id[]` and `doc_start[]` (token offsets
within the shard) and `code`, a byte string laid out per level as

    u64 count | count chunk bytes | packed continuation bits, little-endian in each byte | u32 rank directory

Level 0 holds the low 8 bits of every id. A token's continuation bit is set if its id needs a further chunk; level
k + 1 then holds the next 8 bits of just those tokens, in order. The rank directory has the number of set bits before
every block of 512, so the place of a token's next chunk is one directory entry plus the popcount of at most one
block: any token is read in O(levels) without decoding its neighbours.

Shards are rows of Parquet files in the shared folder, written by Spark from a range partitioning on doc_id, in
ascending (file, shard) order. Edge cases: a null text is empty and yields the end id only; null ids come first;
repeated ids are separate documents, in arbitrary order among themselves; an empty table gives no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import VOCABULARY, Encoder, table, write_shared

BLOCK = 512
SHARD_TOKENS = 1 << 20


def encode_ids(ids: np.ndarray) -> bytes:
    """The levels of one shard."""
    out, rest = [], ids.astype(np.uint64)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ranks = np.zeros(len(more) // BLOCK + 1, np.int64)
        full = len(more) // BLOCK * BLOCK
        np.cumsum(more[:full].reshape(-1, BLOCK).sum(1), out=ranks[1:])
        out += [np.uint64(len(rest)).tobytes(), (rest & np.uint64(255)).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
        if not more.any():
            return b"".join(out)
        rest = rest[more] >> np.uint64(8)


class Codes:
    """Random access to an encoded shard."""

    def __init__(self, code: bytes):
        self.levels, at = [], 0
        while at < len(code):
            n = int(np.frombuffer(code, "<u8", 1, at)[0])
            nb, nr = -(-n // 8), n // BLOCK + 1
            self.levels.append((np.frombuffer(code, np.uint8, n, at + 8), np.frombuffer(code, np.uint8, nb, at + 8 + n), np.frombuffer(code, "<u4", nr, at + 8 + n + nb)))
            at += 8 + n + nb + 4 * nr

    def _rank(self, level: int, i: int) -> int:
        _, bits, ranks = self.levels[level]
        block = i // BLOCK
        lo, hi = block * BLOCK // 8, i // 8
        n = int(ranks[block]) + int(np.unpackbits(bits[lo:hi]).sum())
        return n + (int(bits[hi] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def token(self, i: int) -> int:
        """Id of token i."""
        value, level = 0, 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[i]) << 8 * level
            if not bits[i // 8] >> i % 8 & 1:
                return value
            i, level = self._rank(level, i), level + 1

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids of tokens start to end: one rank look-up per level, then only the chunks of the range."""
        value = self.levels[0][0][start:end].astype(np.uint32)
        where = None
        for level in range(len(self.levels)):
            more = np.flatnonzero(np.unpackbits(self.levels[level][1][start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start])
            if not len(more):
                break
            where = more if where is None else where[more]
            start = self._rank(level, start)
            end = start + len(more)
            value[where] |= self.levels[level + 1][0][start:end].astype(np.uint32) << np.uint32(8 * level + 8)
        return value


SHARDS = pa.schema([("file", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("code", pa.binary())])
SHARD_DDL = "file int, shard int, n_tokens long, doc_ids array<bigint>, doc_starts array<bigint>, code binary"


def write_token_files(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes every text, appends end_id, writes the shards, and returns the table of the written files."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = Encoder.get(vocabulary), np.array([end_id], "<u4").tobytes()
        file, shard, ids, starts, parts, total = TaskContext.get().partitionId(), 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            code = encode_ids(np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(([file], [shard], [total], [ids], [starts], [code]), SHARDS)], schema=SHARDS)

        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                for doc, x in zip(some.column(0).to_pylist(), encoder.encode(some.column(1))):
                    ids.append(doc)
                    starts.append(total)
                    parts += (x, end)
                    total += len(x) // 4 + 1
                    if total >= shard_tokens:
                        yield close()
                        shard, ids, starts, parts, total = shard + 1, [], [], [], 0
        if ids:
            yield close()

    dealt = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return write_shared(dealt.mapInArrow(shards, SHARD_DDL))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    sizes = files.select("file", "shard", "n_tokens")
    per_file = sizes.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    upto = Window.unboundedPreceding, -1
    per_file = per_file.select("file", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("file").rowsBetween(*upto)), F.lit(0)).alias("file_start"))
    starts = sizes.select("file", "shard", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("shard").rowsBetween(*upto)), F.lit(0)).alias("in_file"))
    starts = starts.join(per_file, "file").select("file", "shard", (F.col("file_start") + F.col("in_file")).alias("shard_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, starts = Codes(row["code"]), row["doc_starts"]
                ends = [*starts[1:], row["n_tokens"]]
                # each document is read by itself, through the rank directories, as a reader of one document would
                crc = [zlib.crc32(codes.tokens(s, e).astype("<u4", copy=False)) for s, e in zip(starts, ends)]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array([e - s for s, e in zip(starts, ends)], pa.int64()), pa.array(crc, pa.int64())],
                    names=["file", "shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"],
                )

    rows = files.mapInArrow(documents, "file int, shard int, doc_id long, in_shard long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["file", "shard"]).select("doc_id", (F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))
