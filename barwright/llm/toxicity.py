"""Toxicity by maximum-scoring segments over token log-odds.

Model. A token's features are its whole word and its first 6, 5 and 4 bytes (lower case). Features that occur in at
least `least` toxic training documents are listed; a token's type is its longest listed feature. Training documents are a
bounded sample and a feature needs `least` of its toxic documents, so the list is bounded by a `least`-th of that
sample's distinct features. Types get log-odds of toxic against clean documents under a Dirichlet prior centred on the parent
feature's estimate; less a constant drift they are the token scores, negative on average.

Scan. All maximal scoring segments of a document are found in one linear pass (Ruzzo and Tompa). With lambda and K of
the extreme-value law of the best segment in clean text (Karlin and Altschul), the r best segments of a document of n
tokens have the normalised sum T = sum(lambda * S - ln(K n)) and the tail exp(-T) T^(r-1) / (r! (r-1)!); the document's
statistic is the best -log tail over r. A logistic curve, fitted on training documents that the counts did not use,
turns it into the score. Segments whose own tail is below `significant` are the toxic passages.

Training uses at most `sample` labelled documents, those with the smallest hash of the id (a documented bound); ids
with crc32 mod 3 = 1 are never used. Every text is scored whole.

Edge cases: null and empty texts have no token and get the score of the statistic 0; a document labelled more than once
is toxic if any label says so; null labels are ignored; without labels of both classes every score is the share of
toxic labels; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FIRST_BYTES, is_held_out, mix, slices, table, write_shared

#: Everything in ASCII that is no letter separates tokens.
SEPARATOR = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LEVELS = (4, 5, 6, 1 << 30)
SALT = [np.uint64(0x51ED270B35A7C1F1 * (k + 1) % (1 << 64)) for k in range(len(LEVELS))]


def features(t) -> list[np.ndarray]:
    """Per level, the feature hash of every token of a slice."""
    head, length = t.eight()[t.starts], t.ends - t.starts
    return [mix(mix(head & FIRST_BYTES[np.minimum(length, n)]) ^ SALT[k]) for k, n in enumerate(LEVELS[:-1])] + [mix(t.words() ^ SALT[-1])]


class Lexicon:
    """Sorted feature hashes with a bit-table before the binary search."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[self._low(self.hashes)] = True

    def _low(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        if len(self.hashes):
            at = np.flatnonzero(self.maybe[self._low(h)])
            i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[i] == h[at], i, -1)
        return out

    def types(self, levels: list[np.ndarray]) -> np.ndarray:
        """The longest listed feature of each token, or -1."""
        out = self.find(levels[-1])
        for h in levels[-2::-1]:
            at = np.flatnonzero(out < 0)
            out[at] = self.find(h[at])
        return out


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _distinct(doc: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (doc, what)."""
    order = np.lexsort((what, doc))
    d, w = doc[order], what[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
    return d[new], w[new]


def maximal_segments(scores: list[float]) -> list[float]:
    """Scores of all maximal scoring segments (Ruzzo-Tompa), in linear time."""
    left: list[float] = []
    right: list[float] = []
    link: list[int] = []  # the nearest earlier candidate with a smaller left sum
    total = 0.0
    for s in scores:
        if s <= 0:
            total += s
            continue
        lo, hi = total, total + s
        total = hi
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = link[j]
            if j < 0 or right[j] >= hi:
                left.append(lo)
                right.append(hi)
                link.append(j)
                break
            lo = left[j]
            del left[j:], right[j:], link[j:]
    return [b - a for a, b in zip(left, right)]


class Model:
    """Type scores with the constants of the extreme-value law and of the calibration curve."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray, drift: float):
        order = np.argsort(hashes)
        self.lexicon, self.scores, self.drift = Lexicon(hashes), scores[order], drift
        self.rate, self.k, self.curve = 1.0, 0.1, (0.0, 0.0)

    def segments(self, texts: pa.Array) -> Iterator[tuple[int, int, list[float]]]:
        """(row, number of tokens, segment scores) of each text."""
        for t in slices(texts, fold=True, space=SEPARATOR):
            kind = self.lexicon.types(features(t)) if len(t.starts) else np.zeros(0, np.int64)
            score = np.full(len(kind), -self.drift)
            score[kind >= 0] = self.scores[kind[kind >= 0]]
            hits = np.flatnonzero(score > 0)
            bounds = np.searchsorted(hits, t.first)
            run = np.zeros(len(score) + 1)
            np.cumsum(score, out=run[1:])
            for d in range(t.n):
                own = hits[bounds[d] : bounds[d + 1]]
                seq: list[float] = []
                for i, h in enumerate(own):  # sums between the hits stand for the tokens there
                    if i:
                        seq.append(float(run[h] - run[own[i - 1] + 1]))
                    seq.append(float(score[h]))
                yield t.first_row + d, int(t.first[d + 1] - t.first[d]), maximal_segments(seq)

    def statistic(self, n: int, segments: list[float]) -> float:
        best = total = tail = 0.0
        floor = math.log(max(self.k * n, 1e-9)) if n else 0.0
        for r, s in enumerate(sorted(segments, reverse=True), 1):
            total += self.rate * s - floor
            if total <= 0:
                break
            tail = total - (r - 1) * math.log(max(total, 1e-9)) + math.lgamma(r + 1) + math.lgamma(r)
            best = max(best, tail)
        return best

    def significant(self, n: int, segments: list[float], tail: float) -> int:
        return sum(self.k * n * math.exp(-self.rate * s) < tail for s in segments)

    def score(self, x: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * x))))


def _fit_curve(x: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Ridge logistic regression on weighted points, by Newton steps."""
    a, b = -2.0, 0.5
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -50, 50)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(toxic - n * p).sum(), ((toxic - n * p) * x).sum()]) - 1e-3 * np.array([a, b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]]) + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], max(b + step[1], 1e-3)
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 40_000, least: int = 3, prior: float = 3.0, drift: float = 0.5) -> Model | float:
    """A model, or the share of toxic labels where there are not both classes."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("calibrates", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)) == 0)
    rows = known.collect()  # at most `sample` rows
    toxic = sum(r["toxic"] == 1 for r in rows)
    if not toxic or toxic == len(rows):
        return toxic / len(rows) if rows else 0.0
    known = spark.createDataFrame([(r["doc_id"], int(r["toxic"]), bool(r["calibrates"])) for r in rows], "doc_id long, toxic int, calibrates boolean")
    # the sample is bounded, so it is sent to the documents and not the reverse
    train = write_shared(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("toxic", "calibrates", "text"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(0), fold=True, space=SEPARATOR):
                if not len(t.starts):
                    continue
                doc = np.repeat(np.arange(t.n), np.diff(t.first))
                levels = features(t)
                for k, h in enumerate(levels):
                    _, f = _distinct(doc, h)
                    uniq, n = np.unique(f, return_counts=True)
                    parent = np.zeros(len(uniq), np.uint64)
                    if k:
                        parent[np.searchsorted(uniq, h)] = levels[k - 1]
                    yield _rows(["feature", "parent", "level", "n"], uniq.view(np.int64), parent.view(np.int64), np.full(len(uniq), k, np.int32), n.astype(np.int64))

    counted = train.where("toxic = 1 and not calibrates").select("text").mapInArrow(listed, "feature long, parent long, level int, n long")
    counted = counted.groupBy("feature").agg(F.sum("n").alias("n"), F.min("parent").alias("parent"), F.min("level").alias("level")).where(F.col("n") >= least)
    listing = counted.collect()  # bounded by the sample
    if not listing:
        return toxic / len(rows)
    lexicon = Lexicon(np.array([r["feature"] for r in listing], np.int64).view(np.uint64))
    size = len(lexicon.hashes)

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, tokens = np.zeros((2, size + 1), np.int64), np.zeros((2, size + 1), np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for t in slices(batch.column(1), fold=True, space=SEPARATOR):
                if len(t.starts):
                    kind = lexicon.types(features(t))
                    kind[kind < 0] = size
                    doc = np.repeat(np.arange(t.n), np.diff(t.first))
                    y = label[t.first_row + doc]
                    d, w = _distinct(doc, kind)
                    for c in (0, 1):
                        tokens[c] += np.bincount(kind[y == c], minlength=size + 1)
                        docs_[c] += np.bincount(w[label[t.first_row + d] == c], minlength=size + 1)
        at = np.flatnonzero(tokens.sum(0))
        yield _rows(["type", "clean", "toxic", "clean_tokens"], at, docs_[0][at], docs_[1][at], tokens[0][at])

    sums = train.where("not calibrates").select("toxic", "text").mapInArrow(typed, "type long, clean long, toxic long, clean_tokens long")
    sums = sums.groupBy("type").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.sum("clean_tokens").alias("clean_tokens")).collect()  # one row per listed feature
    clean, bad, tokens = (np.zeros(size + 1) for _ in range(3))
    for r in sums:
        clean[r["type"]], bad[r["type"]], tokens[r["type"]] = r["clean"], r["toxic"], r["clean_tokens"]

    # estimates from the short features to the long ones; a feature's sums include those of its extensions
    of = {int(np.int64(r["feature"]).view(np.uint64)): r for r in listing}
    place = {int(h): i for i, h in enumerate(lexicon.hashes)}
    parent, level = np.full(size, -1), np.zeros(size, int)
    for h, i in place.items():
        level[i] = of[h]["level"]
        parent[i] = place.get(int(np.int64(of[h]["parent"]).view(np.uint64)), -1) if level[i] else -1
    all_bad, all_clean = bad[:size].copy(), clean[:size].copy()
    for k in range(len(LEVELS) - 1, 0, -1):
        at = np.flatnonzero((level == k) & (parent >= 0))
        np.add.at(all_bad, parent[at], all_bad[at])
        np.add.at(all_clean, parent[at], all_clean[at])
    trained = [r for r in rows if not r["calibrates"]]
    base = sum(r["toxic"] == 1 for r in trained) / len(trained)
    base = min(max(base, 1e-3), 1 - 1e-3)
    whole, own = np.full(size, base), np.full(size, base)
    for k in range(len(LEVELS)):
        at = np.flatnonzero(level == k)
        before = np.where(parent[at] >= 0, whole[np.maximum(parent[at], 0)], base)
        whole[at] = (all_bad[at] + prior * before) / (all_bad[at] + all_clean[at] + prior)
        own[at] = (bad[at] + prior * whole[at]) / (bad[at] + clean[at] + prior)
    odds = np.log(own / (1 - own)) - math.log(base / (1 - base)) - drift
    # listed for the scan: scores above 0, and what lies below such a feature
    keep = odds > 0
    for k in range(1, len(LEVELS)):
        at = np.flatnonzero((level == k) & (parent >= 0))
        keep[at] |= keep[parent[at]]
    scores = np.where(odds > 0, odds, -drift)
    model = Model(lexicon.hashes[keep], scores[keep], drift)

    # lambda: the positive root of sum p exp(lambda s) = 1 over the tokens of clean text
    p = np.append(np.where(keep, tokens[:size], 0), 0)
    p[size] = max(tokens.sum() - p.sum(), 1)
    s = np.append(scores, -drift)
    p, s = p / p.sum(), np.clip(s, -drift, 30)
    excess = lambda x: float((p * np.exp(x * s)).sum()) - 1
    lo, hi = 1e-6, 20.0
    if excess(hi) > 0:
        for _ in range(60):
            lo, hi = ((lo + hi) / 2, hi) if excess((lo + hi) / 2) < 0 else (lo, (lo + hi) / 2)
    model.rate = max(lo if excess(20.0) > 0 else 1.0, 0.05)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_pylist()
            found = [(label[i], n, seg) for i, n, seg in model.segments(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.float64()))], names=["toxic", "n", "segments"])

    held = train.where("calibrates").select("toxic", "text").mapInArrow(scanned, "toxic int, n long, segments array<double>").collect()  # a fifth of `sample`
    quiet = [model.rate * max(r["segments"], default=0.0) - math.log(r["n"]) for r in held if r["toxic"] == 0 and r["n"]]
    if quiet:
        model.k = math.exp(float(np.mean(quiet)) - 0.5772)
    x = np.array([model.statistic(r["n"], r["segments"]) for r in held] or [0.0])
    y = np.array([r["toxic"] for r in held] or [0])
    model.curve = _fit_curve(x, y, np.ones(len(x)))
    return model


def score_documents(docs: DataFrame, model: Model | float, significant: float = 0.01) -> DataFrame:
    """doc_id, score, n_passages (significant toxic segments) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                score, passages = [model] * len(batch), [0] * len(batch)
            else:
                found = [(model.score(model.statistic(n, seg)), model.significant(n, seg, significant)) for _, n, seg in model.segments(batch.column(1))]
                score, passages = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(passages, pa.int64())], names=["doc_id", "score", "n_passages"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, score double, n_passages long")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    model = fit(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            if isinstance(model, float):
                good = [model < threshold] * len(batch)
            else:
                good = [model.score(model.statistic(n, seg)) < threshold for _, n, seg in model.segments(texts)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages")
