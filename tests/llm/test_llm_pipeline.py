"""The corpus pipeline: what each stage keeps of its input, against brute force."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from test_llm_queries import crc, documents, ids_of, jaccard_brute, words

import __spark_entry__
import corpus_pipeline
from barwright.llm import mixing, secrets, toxicity
from barwright.llm.common import write_shared


@pytest.fixture(scope="module", params=["sf", "edge"])
def stages(request, spark):
    """(folder, the rows that go into each stage and come out of the last)."""
    at = request.getfixturevalue(request.param)
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        seen.append([r.asDict() for r in docs.collect()])
        columns, docs = docs.columns, write_shared(stage(spark, docs, at))
        assert docs.columns == columns or len(seen) == len(corpus_pipeline.STAGES)
    return at, [*seen, [r.asDict() for r in docs.collect()]]


def test_toxic_documents_go_and_no_others(spark, stages):
    at, (before, after, *_) = stages
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    good = toxicity.score_documents(docs, model).where("score < 0.7").select("doc_id").collect()
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in good)
    assert not Counter(map(str, after)) - Counter(map(str, before)) and len(after) > 0.8 * len(before)


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1][1:3]
    want = [d for d, r in zip(before, jaccard_brute(before, 5, Fraction(4, 5))) if r["component_id"] is None or r["component_id"] == d["doc_id"]]
    # rows that repeat an id and its text are one document
    once = {(d["doc_id"], d["text"]): d for d in want if d["doc_id"] is not None}
    want = [*once.values(), *[d for d in want if d["doc_id"] is None]]
    assert Counter(map(str, after)) == Counter(map(str, want))


def test_no_secret_stays_in_the_text(stages):
    before, after = stages[1][2:4]
    scanner = secrets.Scanner()
    want = Counter(str({**d, "text": d["text"] and secrets.redacted(d["text"], scanner.text_spans(d["text"]))}) for d in before)
    assert Counter(map(str, after)) == want
    assert not any(re.search("AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r["text"] or "") for r in after)


def test_copies_are_those_of_the_mix(spark, stages):
    before, after = stages[1][3:5]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in before]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = Counter()
    for r in mixed:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in after) == +want


def test_the_mix_is_packed_whole(stages):
    mix, packed = stages[1][4:6]
    want = Counter()
    for d in mix:
        ids = ids_of(d["text"])
        start, length, piece = 0, len(ids) % 2048 or 2048, 0
        while start < len(ids):
            want[d["doc_id"], piece, start, length, crc(ids[start : start + length])] += 1
            start, length, piece = start + length, 2048, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(x[1] for x in seq) <= 2048 and len({x[0] for x in seq}) == len(seq) for seq in by.values())


def test_run_is_the_stages(spark, stages):
    assert Counter(r["length"] for r in corpus_pipeline.run(spark, stages[0]).collect()) == Counter(r["length"] for r in stages[1][-1])
    assert "pipeline" in __spark_entry__.queries() and len(documents(stages[0])) > 0


def test_an_empty_table_goes_through(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
