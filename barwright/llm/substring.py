"""Substring dedup by level-wise doubling of repeated word windows.

A window can only repeat if its halves do, so each level keeps the windows that repeat at its length and extends only
those to twice the length, until no candidates survive or the asked length is reached.

* Copies of whole documents (equal word sequences) are settled first: only the one with the smallest doc_id is compared.
* The first level looks at windows of half the asked length L. Of the L/2 + 1 such windows inside each window of L words
  only the one with the smallest hash is kept, as its anchor; equal windows hold equal anchors. A window of L words is
  extended from its anchor, if that repeats in another document.
* Each further level hashes its candidates to 128 bits and finds the smallest doc_id in which each starts. A window of twice
  the length is a candidate if both its halves repeat. Aggregations combine on the map side and are joined back, so
  that a passage in a third of all documents is never gathered in one place.

A word is removed if a window of L words that covers it also starts in a document with a smaller doc_id; these windows are
all found at the level of L words, where `remove_repeats` stops; `longest_repeats` doubles on to the end. Windows are
judged on the input. Words are runs without ASCII white space, unchanged. Windows are told apart by 128-bit hashes.

Edge cases: a null text has no words; texts shorter than a window lose nothing; rows that repeat a doc_id, with the same
text or with others, are one document to each other (no copy within an id is removed) and each gets its own result; a row
with a null id loses nothing; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sequences, slices, table, windows, write_shared

def anchors_of(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the smallest hash in each `width` consecutive ones (the first, if equal); the first window that each place
    stands for, and how many."""
    if len(h) < width:
        return (np.zeros(0, np.int64),) * 3
    small = np.lib.stride_tricks.sliding_window_view(h, width).argmin(1) + np.arange(len(h) - width + 1)
    first = np.flatnonzero(np.append(True, small[1:] != small[:-1]))
    return small[first], first, np.diff(np.append(first, len(small)))


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, n_words, the word sequence's key (k1, k2), and the hashes of the anchors of its windows of `length` words."""
    half = length // 2
    width = length - half + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, hashes = [], [[], []], []
            for t in slices(batch.column(1)):
                w = [t.words(0), t.words(1)]
                for lane in (0, 1):
                    keys[lane].append(sequences(w[lane], t.first, lane).view(np.int64))
                h = windows(w[0], half, 0)
                for d in range(t.n):
                    lo, hi = int(t.first[d]), int(t.first[d + 1])
                    n.append(hi - lo)
                    at, _, _ = anchors_of(h[lo : hi - half + 1] if hi - lo >= length else h[:0], width)
                    hashes.append(np.unique(h[lo + at]).view(np.int64))
            one = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one(keys[0])), pa.array(one(keys[1])), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "n_words", "k1", "k2", "anchors"])

    if length < 2:
        raise ValueError("windows have two halves")
    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_words long, k1 long, k2 long, anchors array<bigint>")


def listed(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the known ones."""
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def first_candidates(w: np.ndarray, known: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of `length` words whose anchors are known."""
    half = length // 2
    h = windows(w, half, 0).view(np.int64)
    at, first, many = anchors_of(h.view(np.uint64), length - half + 1)
    keep = listed(h[at], known)
    first, many = first[keep], many[keep]
    return np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())


def next_candidates(w: np.ndarray, known: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of `length` words both halves of which are known."""
    s = np.flatnonzero(listed(windows(w, length // 2, 0).view(np.int64), known))
    return np.intersect1d(s, s - length // 2)


def hashed_windows(texts: DataFrame, length: int, starts_of) -> DataFrame:
    """doc_id, (h1, h2) of the windows of `length` words at starts_of(words, known, length), for rows (doc_id, text, known)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(2)
            for t in slices(batch.column(1)):
                w = [t.words(0), t.words(1)]
                h = [windows(x, length, lane).view(np.int64) for lane, x in enumerate(w)]
                at, rows = [], []
                for d in range(t.n):
                    lo, hi = int(t.first[d]), int(t.first[d + 1])
                    s = starts_of(w[0][lo:hi], np.asarray(known[t.first_row + d].values), length) if hi - lo >= length else np.zeros(0, np.int64)
                    s = lo + s[np.unique(h[0][lo + s], return_index=True)[1]]  # a window that repeats within a document counts once
                    at.append(s)
                    rows.append(np.full(len(s), t.first_row + d))
                at, rows = np.concatenate(at), np.concatenate(rows)
                if len(at):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(h[0][at]), pa.array(h[1][at])], names=["doc_id", "h1", "h2"])

    return texts.select("doc_id", "text", "known").mapInArrow(scan, "doc_id long, h1 long, h2 long")


def levels(docs: DataFrame, first: DataFrame, length: int) -> Iterator[tuple[int, DataFrame]]:
    """Level by level from `length` on, doubling: (length, rows (doc_id, h1, lo) of the windows that repeat in another document),
    lo being the smallest doc_id in which the window starts. Ends when no candidates survive."""
    id_ = F.coalesce("doc_id", F.lit(2**63 - 1))
    flat = first.where(F.col("n_words") >= length).select("doc_id", F.explode("anchors").alias("h"))
    # written, so that adaptive execution may split the join at hashes that are in many documents
    again = write_shared(flat.groupBy("h").agg(F.min(id_).alias("lo"), F.max(id_).alias("hi")).where("lo < hi").select("h"))
    known = flat.join(again, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("known"))
    starts_of = first_candidates
    while True:
        texts = docs.select("doc_id", "text").where("text is not null").join(known, "doc_id")
        found = write_shared(hashed_windows(texts, length, starts_of))
        least = found.groupBy("h1", "h2").agg(F.min(id_).alias("lo"), F.max(id_).alias("hi")).where("lo < hi").select("h1", "h2", "lo")
        level = found.join(least, ["h1", "h2"]).select("doc_id", "h1", "lo")
        yield length, level
        known, starts_of, length = level.groupBy("doc_id").agg(F.collect_set("h1").alias("known")), next_candidates, 2 * length
        known = write_shared(known)
        if known.isEmpty():
            return


def repeated_windows(docs: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame]:
    """(doc_id, copied: the keys k1 of its word sequences that are copies of whole documents with a smaller id), (doc_id,
    repeated: the hashes of its windows of `length` words that also start in a document with a smaller id)."""
    first = write_shared(anchor_rows(docs, length))
    heads = write_shared(first.groupBy("n_words", "k1", "k2").agg(F.min("doc_id").alias("head")))
    rows = first.join(heads, ["n_words", "k1", "k2"]).withColumn("copy", F.coalesce(F.col("doc_id") > F.col("head"), F.lit(False)))
    _, level = next(levels(docs, rows.where("not copy"), length))
    copies = rows.where("copy").where(F.col("n_words") >= length).groupBy("doc_id").agg(F.collect_set("k1").alias("copied"))
    return copies, level.where(F.col("doc_id") > F.col("lo")).groupBy("doc_id").agg(F.collect_set("h1").alias("repeated"))


def cover(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n words the windows cover."""
    mark, starts = np.zeros(n + 1, np.int64), starts[starts <= n - length]
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + length, -1)
    return np.cumsum(mark[:n]) > 0


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one space, of every row. What is removed depends on the id and
    the words alone, so rows that repeat an id need no telling apart."""
    copies, hits = repeated_windows(docs, length)
    every = docs.select("doc_id", "text").join(copies.join(hits, "doc_id", "full"), "doc_id", "left").select("doc_id", "text", "copied", "repeated")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for t in slices(batch.column(1)):
                w, some = None, batch.slice(t.first_row, t.n)
                texts = some.column(1).to_pylist()
                for d in range(t.n):
                    lo, hi = int(t.first[d]), int(t.first[d + 1])
                    copied, repeated = some.column(2)[d], some.column(3)[d]
                    out = None
                    if hi - lo >= length and (copied.is_valid or repeated.is_valid):
                        w = t.words(0) if w is None else w
                        own = w[lo:hi]
                        if copied.is_valid and listed(sequences(own, np.array([0, hi - lo]), 0).view(np.int64), np.asarray(copied.values)).all():
                            out = np.ones(hi - lo, bool)
                        elif repeated.is_valid:
                            out = cover(hi - lo, np.flatnonzero(listed(windows(own, length, 0).view(np.int64), np.asarray(repeated.values))), length)
                    words = texts[d].encode().split() if texts[d] else []
                    n.append(len(words))
                    gone.append(0 if out is None else int(out.sum()))
                    kept.append(b" ".join(words if out is None else [x for x, g in zip(words, out.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return every.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


def longest_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, words, windows: per document, the lengths (`length` doubled so many times) at which windows of it repeat in
    another document, and how many different ones; the loop ends when no candidates survive."""
    found = None
    for words, level in levels(docs, write_shared(anchor_rows(docs, length)), length):
        level = level.groupBy("doc_id").agg(F.lit(words).alias("words"), F.countDistinct("h1").alias("windows"))
        found = level if found is None else found.union(level)
    return found


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
