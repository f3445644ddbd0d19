"""Alignment of two tokenizers' tokens over the bytes of each text.

Both tokenizers' tokens lay end to end over the same bytes. The union of their end offsets cuts the bytes into elementary
intervals; a search of each interval's end among the ends of A and of B gives the two tokens that own it, and each
interval is one overlap, so one link. Ends that both have close the groups, whose tokens are written as A ids | B ids;
`group_products` spreads a group into all its pairs. Many texts are done at once, their bytes laid end to end.

An id pair's count is the number of documents that hold it linked. Documents travel in chunks of some megabytes of text. A
chunk keeps the list of its distinct pairs, and each of its documents the places of its pairs in that list; so one row a chunk
and pair is shuffled, not one a document and pair, to be counted and to bring the counts back. A pair that is in every
document is in every chunk once. Chunks are written to the shared folder; they are bounded by their texts.

A: byte-level BPE of the space and the text; B: sentencepiece of the text, which adds the space itself. The strings of special
tokens are plain text. Texts are cut at spaces between words, where neither tokenizer merges, and each piece is encoded
once a worker (tests hold both against the libraries on whole texts).

Edge cases: a text that is null or empty, or whose tokens do not spell its bytes in A or in B (U+2581 in the text, which B
reads as a space), has no tokens and all figures 0; null and repeated ids are documents of their own; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SYMBOLS, VOCABULARY, Encoder, small_batches, table, vocabulary_path, write_shared

PIECES = "piece_bpe_32k.model"
#: Bytes of text a chunk.
CHUNK = 8 << 20
_ITEM = re.compile(" +[^ ]*")


class PieceEncoder:
    """Ids of sentencepiece with a cache of words. No piece of the vocabulary has a space after another character, so no merge
    crosses from a word into the spaces before the next one."""

    ROOM = 250_000
    LONGEST = 64

    def __init__(self, model: str = PIECES):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=vocabulary_path(model))
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("pieces that join words cannot be cut at spaces")
        self.bytes = [bytes([int(x[3:5], 16)]) if self.library.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.space = array("I", [self.library.piece_to_id("▁")]).tobytes()
        self.cache = {" ": self.space}

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new pieces, which go into the cache unless they are long; none of a piece that its ids do not spell."""
        ids = self.library.encode([p[1:] for p in new], num_threads=1)
        got = {p: array("I", x).tobytes() if b"".join([self.bytes[i] for i in x]) == p.encode() else b"" for p, x in zip(new, ids)}
        self.cache.update((p, x) for p, x in got.items() if len(p) <= self.LONGEST)
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of the texts, little-endian unsigned 32-bit; none where they do not spell the space and the text."""
        # U+2581 is the library's own sign for a space: texts that hold it are not cut
        cut = [([" " + x] if "▁" in x else _ITEM.findall(" " + x)) if x else [] for x in texts]
        if len(self.cache) > self.ROOM:
            self.cache = {" ": self.space}
        look = self.cache.get
        found = [list(map(look, parts)) for parts in cut]
        new = {p for parts, got in zip(cut, found) if None in got for p, x in zip(parts, got) if x is None}
        fresh = self._learn(list(new)) if new else {}
        out = []
        for parts, got in zip(cut, found):
            if None in got:
                got = [fresh[p] if x is None else x for p, x in zip(parts, got)]
            out.append(b"" if b"" in got else b"".join(got))
        return out


class Tokens:
    """Both tokenizers of a Python worker, the bytes that every id stands for, and its text in the digest."""

    made: dict[tuple[str, str], Tokens] = {}

    def __init__(self, a: str, b: str):
        self.a, self.b = Encoder.get(a), PieceEncoder(b)
        byte_of = {chr(c) if c not in _SYMBOLS else chr(_SYMBOLS[c]): c for c in range(256)}
        names = [self.a.library.id_to_token(i) for i in range(self.a.library.get_vocab_size())]
        a_bytes = [bytes(map(byte_of.__getitem__, x)) if all(c in byte_of for c in x) else x.encode() for x in names]
        self.spelt = a_bytes, self.b.bytes
        self.lengths = tuple(np.array(list(map(len, x)), np.int64) for x in self.spelt)
        # what an id adds to the digest: 2 * id, and 2 * id + 1 where it ends its side of a group
        self.written = [x for i in range(len(a_bytes)) for x in (f"{i},".encode(), f"{i}|".encode())] + [x for i in range(len(self.b.bytes)) for x in (f"{i},".encode(), f"{i};".encode())]
        self.first_b = 2 * len(a_bytes)

    @classmethod
    def get(cls, a: str, b: str) -> Tokens:
        if (a, b) not in cls.made:
            cls.made[a, b] = cls(a, b)
        return cls.made[a, b]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of every text; none where the tokens do not spell the space and the text."""
        none = np.zeros(0, np.uint32)
        out = [none] * len(texts), [none] * len(texts)
        at = [i for i, x in enumerate(texts) if x]
        spaced = [" " + texts[i] for i in at]
        for i, text, a, b in zip(at, spaced, self.a.encode(spaced), self.b.encode([texts[i] for i in at])):
            a = np.frombuffer(a, "<u4")
            if b and b"".join(map(self.spelt[0].__getitem__, a.tolist())) == text.encode():
                out[0][i], out[1][i] = a, np.frombuffer(b, "<u4")
        return out


class Alignment:
    """Tokens of several texts, end to end: ids and byte ends of A and B, the owners of each elementary interval, the groups."""

    def __init__(self, tokens: Tokens, a: list[np.ndarray], b: list[np.ndarray]):
        self.first_a, self.first_b = (np.fromiter(accumulate(map(len, x), initial=0), np.int64, len(x) + 1) for x in (a, b))
        self.a, self.b = (np.concatenate([np.zeros(0, np.uint32), *x]).astype(np.int64) for x in (a, b))
        end_a, end_b = np.cumsum(tokens.lengths[0][self.a]), np.cumsum(tokens.lengths[1][self.b])
        cuts = np.union1d(end_a, end_b)
        self.own_a, self.own_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        # a shared end closes a group; the ends of every text are shared
        self.last_a, self.last_b = (np.isin(x, y, assume_unique=True) for x, y in ((end_a, end_b), (end_b, end_a)))
        self.group_a, self.group_b = (np.cumsum(x) - x for x in (self.last_a, self.last_b))
        self.first_link = np.searchsorted(self.own_a, self.first_a)

    def digests(self, tokens: Tokens) -> tuple[np.ndarray, list[str]]:
        """The number of groups of every text and the sha256 of their writing (nothing where there are no tokens)."""
        n = int(self.group_a[-1]) + 1 if len(self.a) else 0
        per_a, per_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        place_a = np.arange(len(self.a)) + (np.cumsum(per_b) - per_b)[self.group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(per_a)[self.group_b]
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[place_a] = 2 * self.a + self.last_a
        codes[place_b] = tokens.first_b + 2 * self.b + self.last_b
        first, words = (self.first_a + self.first_b).tolist(), list(map(tokens.written.__getitem__, codes.tolist()))
        sha = [hashlib.sha256(b"".join(words[s:e])[:-1]).hexdigest() if e > s else "" for s, e in zip(first, first[1:])]
        closed = np.append(0, np.cumsum(self.last_a))
        return closed[self.first_a[1:]] - closed[self.first_a[:-1]], sha


CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("pairs", pa.binary()), ("held", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
    ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())), ("n_pairs", pa.list_(pa.int64())), ("places", pa.binary()), ("times", pa.binary()),
])
CHUNKS_DDL = "chunk long, pairs binary, held binary, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>, n_pairs array<bigint>, places binary, times binary"


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each is there."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return x[first], np.diff(np.append(first, len(x)))


def aligned_part(tokens: Tokens, ids: list, texts: list[str | None]) -> tuple:
    """What a chunk keeps of some texts: figures per document, and the distinct pairs of each with their numbers of links."""
    al = Alignment(tokens, *tokens.encode(texts))
    groups, sha = al.digests(tokens)
    links = np.diff(al.first_link)
    pairs = al.a[al.own_a] << 32 | al.b[al.own_b]
    own, times, n = [], [], []
    for s, e in zip(al.first_link.tolist(), al.first_link[1:].tolist()):
        one, many = runs(np.sort(pairs[s:e]))
        own.append(one)
        times.append(many)
        n.append(len(one))
    return ids, np.diff(al.first_a).tolist(), np.diff(al.first_b).tolist(), groups.tolist(), links.tolist(), sha, n, own, times


def aligned_chunks(docs: DataFrame, a: str = VOCABULARY, b: str = PIECES, chunk: int = CHUNK) -> DataFrame:
    """One row for each chunk of documents, written to the shared folder: its distinct pairs with the number of its documents
    that hold each, and per document the figures, the places of its pairs among the chunk's, and their numbers of links."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, number = Tokens.get(a, b), TaskContext.get().partitionId() << 32
        parts, size = [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, parts, size
            columns = [[x for part in parts for x in part[k]] for k in range(9)]
            flat = np.concatenate([np.zeros(0, np.int64), *columns[7]])
            pairs, places, held = np.unique(flat, return_inverse=True, return_counts=True)
            values = [number, pairs.astype("<i8").tobytes(), held.astype("<i8").tobytes(), *columns[:7], places.astype("<u4").tobytes(), np.concatenate([np.zeros(0, np.int64), *columns[8]]).astype("<u4").tobytes()]
            number, parts, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, CHUNKS)], schema=CHUNKS)

        for batch in batches:
            for at in range(0, len(batch), 128):
                some = batch.slice(at, 128)
                parts.append(aligned_part(tokens, some.column(0).to_pylist(), some.column(1).to_pylist()))
                size += some.column(1).nbytes
                if size >= chunk:
                    yield close()
        if parts:
            yield close()

    return write_shared(docs.select("doc_id", "text").mapInArrow(scan, CHUNKS_DDL))


def chunk_pairs(chunks: DataFrame) -> DataFrame:
    """chunk, place, a, b, held: the distinct pairs of every chunk."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, held in zip(*(batch.column(k).to_pylist() for k in range(3))):
                pairs, held = np.frombuffer(pairs, "<i8"), np.frombuffer(held, "<i8")
                for at in range(0, len(pairs), 50_000):
                    p = pairs[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), chunk)), pa.array(np.arange(at, at + len(p), dtype=np.int32)), pa.array((p >> 32).astype(np.int32)), pa.array((p & 0xFFFFFFFF).astype(np.int32)), pa.array(held[at : at + len(p)])],
                        names=["chunk", "place", "a", "b", "held"],
                    )

    return chunks.select("chunk", "pairs", "held").mapInArrow(spread, "chunk long, place int, a int, b int, held long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked), best (n is the highest of its a), for every pair of the corpus."""
    counts = pairs.groupBy("a", "b").agg(F.sum("held").alias("n"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, a: str = VOCABULARY, b: str = PIECES, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    small_batches(docs.sparkSession)
    chunks = aligned_chunks(docs, a, b, chunk)
    pairs = chunk_pairs(chunks)
    counts = write_shared(pair_counts(pairs)).withColumnsRenamed({"a": "_a", "b": "_b"})
    found = pairs.join(counts, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("chunk", "place", "n", "best")

    def sums(key, got: pa.Table, kept: pa.Table) -> pa.Table:
        """One chunk: its pairs' counts by place, summed over its documents."""
        place = got.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], best[place] = got.column("n").to_numpy(), got.column("best").cast(pa.int64()).to_numpy()
        out = []
        for row in kept.to_pylist():
            places, times = np.frombuffer(row["places"], "<u4"), np.frombuffer(row["times"], "<u4").astype(np.int64)
            first = np.append(0, np.cumsum(row["n_pairs"])).astype(np.int64)
            total = [np.append(0, np.cumsum(x[places] * times)) for x in (best, n)]
            per = [(x[first[1:]] - x[first[:-1]]) for x in total]
            out.append(pa.table({"doc_id": pa.array(row["doc_id"], pa.int64()), "n_a": pa.array(row["n_a"], pa.int64()), "n_b": pa.array(row["n_b"], pa.int64()), "n_groups": pa.array(row["n_groups"], pa.int64()), "n_links": pa.array(row["n_links"], pa.int64()), "n_best": pa.array(per[0]), "count_sum": pa.array(per[1]), "groups_sha256": pa.array(row["sha"], pa.string())}))
        return pa.concat_tables(out) if out else pa.schema(ALIGNED).empty_table()

    kept = chunks.drop("pairs", "held")
    return found.groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInArrow(sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


ALIGNED = [*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())]


def token_groups(docs: DataFrame, a: str = VOCABULARY, b: str = PIECES) -> DataFrame:
    """doc_id, groups: array of (a_ids, b_ids, start, end) of every row; start and end are byte offsets into the space and text."""
    kind = pa.list_(pa.struct([("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.get(a, b)
        for batch in batches:
            out = []
            for ids_a, ids_b in zip(*tokens.encode(batch.column(1).to_pylist())):
                al = Alignment(tokens, [ids_a], [ids_b])
                cut_a, cut_b = (np.append(0, np.flatnonzero(x) + 1) for x in (al.last_a, al.last_b))
                ends = np.append(0, np.cumsum(tokens.lengths[0][al.a]))[cut_a]
                out.append([{"a_ids": al.a[s:e].tolist(), "b_ids": al.b[t:f].tolist(), "start": int(x), "end": int(y)} for s, e, t, f, x, y in zip(cut_a, cut_a[1:], cut_b, cut_b[1:], ends, ends[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, groups array<struct<a_ids:array<int>,b_ids:array<int>,start:bigint,end:bigint>>")


def group_products(groups: DataFrame) -> DataFrame:
    """doc_id, place, a, b: every A id of a group with every B id of it, overlapping or not (a phrase table's rows)."""
    one = groups.select("doc_id", F.posexplode("groups").alias("place", "g"))
    return one.select("doc_id", "place", F.explode("g.a_ids").alias("a"), "g").select("doc_id", "place", "a", F.explode("g.b_ids").alias("b"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))
