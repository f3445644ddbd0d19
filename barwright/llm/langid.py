"""Language identification as inference of a multilingual mixture.

Byte-trigram models of each language (words in lower case with their ends, counts hashed to a fixed table, additive
smoothing) give every word of a text a likelihood per language. Expectation-maximisation estimates the document's
language proportions; nested sets of its strongest languages are compared by penalised likelihood
(log-likelihood - penalty * (languages - 1) * ln(words)), and the largest proportion in the chosen set is the
prediction, its proportion the score. All documents of a slice go through each step together.

Learned from text and lang of every document whose crc32(doc_id as text) mod 3 is not 1 and whose lang is not null;
predictions use the text alone.

Edge cases: `und` with score 0 for a null text, for one without a letter, and where nothing was learned; ties go to the
language that sorts first; a null doc_id counts as training data; repeated rows are predicted alike; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_held_out, slices, table
from .toxicity import SEPARATOR

BUCKETS = 1 << 16


def trigrams(t) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams around every letter of a slice, and where each word's begin."""
    gap = SEPARATOR[t.data]
    d = np.where(gap, np.uint8(32), t.data).astype(np.uint32)
    before, after = np.empty_like(d), np.empty_like(d)
    before[0], before[1:] = 32, d[:-1]
    after[-1], after[:-1] = 32, d[1:]
    before[t.starts], after[t.ends - 1] = 32, 32
    code = ((before << np.uint32(16) | d << np.uint32(8) | after) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    letters = np.flatnonzero(~gap)
    lengths = t.ends - t.starts
    return code[letters].astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])[:-1]


def count_trigrams(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(language index, bucket, n) over all rows of docs."""
    index = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            lang = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for t in slices(batch.column(1), fold=True, space=SEPARATOR):
                if len(t.starts):
                    code, begins = trigrams(t)
                    doc = np.repeat(np.arange(t.n), np.diff(t.first))
                    n += np.bincount(code + np.repeat(lang[t.first_row + doc], t.ends - t.starts) * BUCKETS, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array((at // BUCKETS).astype(np.int32)), pa.array((at % BUCKETS).astype(np.int32)), pa.array(n[at])], names=["language", "bucket", "n"])

    rows = docs.select("lang", "text").mapInArrow(count, "language int, bucket int, n long")
    return rows.groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, smoothing: float = 0.5, most: int = 1024) -> tuple[list[str], np.ndarray]:
    """The learned languages, sorted, and ln P(trigram | language) as a table of BUCKETS rows. Fails, rather than leave some
    out, if there are more than `most` languages."""
    train = docs.where(F.col("lang").isNotNull() & ~is_held_out("doc_id"))
    # one row per language: a model has a column of BUCKETS numbers for each, so their number is checked
    languages = sorted(r["lang"] for r in train.select("lang").distinct().limit(most + 1).collect())
    if len(languages) > most:
        raise ValueError(f"more than {most} languages are labelled; is lang a column of languages?")
    counts = np.full((BUCKETS, max(len(languages), 1)), smoothing)
    if languages:
        for r in count_trigrams(train, languages).toLocalIterator():  # at most languages x BUCKETS rows
            counts[r["bucket"], r["language"]] += r["n"]
    return languages, np.log(counts / counts.sum(0)).astype(np.float32)


def _em(lik: np.ndarray, top: np.ndarray, doc: np.ndarray, first: np.ndarray, mask: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document over its masked languages. first: where each one's words begin."""
    pi = mask / mask.sum(1, keepdims=True)
    n = np.diff(np.append(first, len(doc)))[:, None]
    for _ in range(steps):
        r = lik * pi[doc]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        pi = np.add.reduceat(r, first, axis=0) / n
    return pi, np.add.reduceat(np.log(np.maximum((lik * pi[doc]).sum(1), 1e-300)) + top, first)


def mixtures(t, logp: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a slice: the documents that have words, and their proportions (0 outside the chosen set)."""
    code, begins = trigrams(t)
    per_word = np.add.reduceat(logp[code], begins, axis=0).astype(np.float64)
    top = per_word.max(1)
    lik = np.exp(per_word - top[:, None])
    words = np.diff(t.first)
    own = np.flatnonzero(words)
    doc, first = np.repeat(np.arange(len(own)), words[own]), t.first[own]
    L = logp.shape[1]
    full, _ = _em(lik, top, doc, first, np.ones((len(own), L)), steps)
    single = np.add.reduceat(per_word, first, axis=0)
    order = np.argsort(-(full + 1e-9 * (single - single.max(1, keepdims=True)) / words[own][:, None]), axis=1, kind="stable")
    best_one = single.argmax(1)
    chosen = np.zeros((len(own), L))
    chosen[np.arange(len(own)), best_one] = 1
    best = single.max(1)
    most = np.add.reduceat(top, first)  # no set is likelier than each word's best language
    for k in range(2, L + 1):
        if not (most - penalty * (k - 1) * np.log(words[own] + 1) + 1e-6 > best).any():
            break
        mask = np.zeros((len(own), L))
        np.put_along_axis(mask, order[:, :k], 1, axis=1)
        pi, ll = _em(lik, top, doc, first, mask, steps)
        value = ll - penalty * (k - 1) * np.log(words[own] + 1)
        better = value > best
        chosen[better], best[better] = pi[better], value[better]
    return own, chosen


def detect(docs: DataFrame, languages: list[str], logp: np.ndarray, penalty: float = 2.0, steps: int = 8) -> DataFrame:
    """doc_id, lang_pred, score, mixture (proportion per language of the chosen set) of every row."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            pred, score = ["und"] * len(batch), np.zeros(len(batch))
            mixture: list[dict] = [{} for _ in range(len(batch))]
            for t in slices(texts, fold=True, space=SEPARATOR) if languages else ():
                if not len(t.starts):
                    continue
                own, pi = mixtures(t, logp, penalty, steps)
                ascii_letter = np.zeros(len(t.data) + 1, np.int64)
                np.cumsum((t.data >= 97) & (t.data <= 122), out=ascii_letter[1:])
                has = ascii_letter[t.offsets[1:]] > ascii_letter[t.offsets[:-1]]
                for d, p in zip(own, pi):
                    i = t.first_row + int(d)
                    if has[d] or any(c.isalpha() for c in texts[i].as_py()):
                        k = int(p.argmax())
                        pred[i], score[i] = languages[k], min(1.0, float(p[k]))
                        mixture[i] = {languages[j]: float(p[j]) for j in np.flatnonzero(p > 0)}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score), pa.array([list(m.items()) for m in mixture], pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "mixture"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect(docs, *fit(docs)).select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
