"""Operators 11 to 13: against plain restatements, on edge cases and on tables that force their further levels."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barwright.llm import common, exact_dups, fill_middle, token_align
from barwright.llm.queries import QUERIES

both = pytest.mark.parametrize("at", ["sf", "edge"])
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def documents(at):
    return pq.read_table(f"{at}/documents.parquet", columns=["doc_id", "text"]).to_pylist()


def multiset(x):
    return Counter(tuple(sorted(r.items(), key=str)) for r in x)


def rows(df):
    return [r.asDict() for r in df.collect()]


# ------------------------------------------------------------------------------------------------------------- op 11
def cut_plainly(doc_id, text):
    text = text or ""
    digest, n = sha("1:" + ("null" if doc_id is None else str(doc_id))), len(text)
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out = "plain", text
    elif h[3] % 100 < 20:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    plain = form == "plain"
    return {"doc_id": doc_id, "n": n, "form": form, "prefix_chars": None if plain else a, "middle_chars": None if plain else b - a, "output_sha256": sha(out), "restored_sha256": sha(text)}


@both
def test_op11_by_brute_force(spark, request, at):
    at = request.getfixturevalue(at)
    want = [cut_plainly(d["doc_id"], d["text"]) for d in documents(at)]
    assert multiset(rows(QUERIES["op11_fill_middle"](spark, at))) == multiset(want)


def test_op11_hot_text_markers_and_code_points(spark):
    texts = ["hot text \U0001f600é中" * 3] * 40 + ["a<P>b", "x<S", "<", "é", "\U0001f600", "a\n\x00b", "S><M", "<P"] * 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"key": F.lit(1), "salt": F.lit(2), "hot": F.lit(3), "count": F.lit(4)})
    got = {r["doc_id"]: r for r in rows(fill_middle.fill_in_middle(docs, copies=7).withColumn("back", fill_middle.restored()))}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        want = cut_plainly(i, x)
        assert got[i]["back"] == x and sha(got[i]["output"]) == want["output_sha256"]
        assert [got[i][c] for c in ("n", "form", "prefix_chars", "middle_chars")] == [want[c] for c in ("n", "form", "prefix_chars", "middle_chars")]


def test_op11_hot_texts_are_dealt_out(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same")).otherwise(F.col("id").cast("string")).alias("text"))
    salts = fill_middle.by_text(docs, copies=100).where("text = 'the same'").groupBy("salt").count().collect()
    assert len(salts) == 17 and max(r["count"] for r in salts) < 150


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=2000))
def test_op11_elias_fano(steps):
    values = np.append(0, np.cumsum(np.array(steps, np.int64)))
    index = fill_middle.EliasFano(values, int(values[-1]))
    assert [index[i] for i in range(len(values))] == values.tolist()
    if len(values) > 1000:
        assert 8 * (len(index.high) + len(index.low)) < 5 * len(values) + 64


# ------------------------------------------------------------------------------------------------------------- op 12
def groups_plainly(docs):
    of = defaultdict(list)
    for i, d in enumerate(docs):
        of[d["text"] or ""].append(i)
    out = []
    for text, at in of.items():
        ids = [docs[i]["doc_id"] for i in at]
        keep = max((x for x in ids if x is not None), default=None)
        marked = False
        for x in ids:
            kept = x == keep and not marked
            marked = marked or kept
            out.append({"doc_id": x, "keep_id": keep, "group_size": len(at), "kept": kept, "text_sha256": sha(text)})
    return out


@both
def test_op12_by_brute_force(spark, request, at):
    at = request.getfixturevalue(at)
    assert multiset(rows(QUERIES["op12_exact_dedup"](spark, at))) == multiset(groups_plainly(documents(at)))


@pytest.mark.parametrize("room,fan_out", [(400, 2), (3000, 3), (1 << 20, 4)])
def test_op12_small_tables_take_further_levels(spark, room, fan_out):
    rng = random.Random(room)
    texts = [f"text {rng.randrange(150)} " * rng.randrange(1, 9) for _ in range(900)] + ["one hot text"] * 5000 + [None, "", "x" * 5000]
    docs = [{"doc_id": i if i % 50 else None, "text": x} for i, x in enumerate(texts)]
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("h", "rec", "bucket", "ids", "top", "bytes")})
    levels = exact_dups.partitioned(exact_dups.local_records(df.repartition(7), room), 40_000, room, fan_out)
    assert (len(levels) > 1) == (room < 1 << 20)
    assert multiset(rows(exact_dups.exact_groups(df.repartition(7), room, fan_out))) == multiset(groups_plainly(docs))


def test_op12_buckets_need_no_shuffle(spark, sf):
    docs = common.table(spark, sf, "documents")
    (files,) = exact_dups.partitioned(exact_dups.local_records(docs), 1 << 26)
    plan = exact_dups.grouped(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_op12_table_compares_contents():
    seen = exact_dups.ContentTable(4)
    first = [seen.entry(h % 3, str(i).encode()) for i, h in enumerate(range(500))]
    assert first == list(range(500)) == [seen.entry(i % 3, str(i).encode()) for i in range(500)]
    assert seen.entry(1, b"") == seen.entry(1, b"") == 500


# ------------------------------------------------------------------------------------------------------------- op 13
@lru_cache
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(common.vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=common.vocabulary_path("piece_bpe_32k.model"))


def align_plainly(docs):
    a, b = libraries()
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in printable} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in printable)}
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    per, count = [], Counter()
    for d in docs:
        text, links, groups, ids_a, ids_b = d["text"], [], [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ends = []
            for spelt in ([bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a], [spell_b(i) for i in ids_b]):
                if b"".join(spelt) != (" " + text).encode():
                    ids_a, ids_b = [], []
                ends.append(np.cumsum([len(x) for x in spelt]).tolist())
            i = j = s = t = at = 0
            while i < len(ids_a) and j < len(ids_b):
                links.append((ids_a[i], ids_b[j]))
                x, y = ends[0][i], ends[1][j]
                i, j, at = i + (x <= y), j + (y <= x), min(x, y)
                if x == y:
                    groups.append(",".join(map(str, ids_a[s:i])) + "|" + ",".join(map(str, ids_b[t:j])))
                    s, t = i, j
        per.append((d["doc_id"], len(ids_a), len(ids_b), links, groups))
        count.update(set(links))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [
        {"doc_id": i, "n_a": na, "n_b": nb, "n_groups": len(g), "n_links": len(ln), "n_best": sum(count[p] == most[p[0]] for p in ln), "count_sum": sum(count[p] for p in ln), "groups_sha256": sha(";".join(g)) if g else ""}
        for i, na, nb, ln, g in per
    ]


@both
def test_op13_by_brute_force(spark, request, at):
    at = request.getfixturevalue(at)
    assert multiset(rows(QUERIES["op13_cross_tokenizer"](spark, at))) == multiset(align_plainly(documents(at)))


ODD = ["a ", "  a  b   ", "▁", "x▁y", "<s> </s> <|endoftext|> <0x41>", "\x00 \x01", "ﬁ 　 é Å", "a\nb\n\nc \n d\t e", "中文 日本語 \U0001f600\U0001f600 zz", "x" * 300 + " " + "é" * 200, " ", "\n", "it's  they'll 1234567 ...!!", "naïve   café x"]


def test_op13_odd_texts_and_small_chunks(spark):
    docs = [{"doc_id": i % 40 or None, "text": x} for i, x in enumerate(ODD * 5 + ["plain words again"] * 30 + [None, ""])]
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("chunk", "pairs", "a", "b", "n", "best", "place", "held")})
    assert multiset(rows(token_align.align_tokens(df.repartition(3), chunk=40))) == multiset(align_plainly(docs))
    groups = token_align.token_groups(df)
    assert groups.where("size(groups) > 0").count() > 0
    bad = groups.where("exists(groups, g -> g.start >= g.end or size(g.a_ids) = 0 or size(g.b_ids) = 0)")
    assert bad.count() == 0
    pairs = groups.agg(F.sum(F.aggregate("groups", F.lit(0).cast("long"), lambda s, g: s + F.size(g["a_ids"]) * F.size(g["b_ids"])))).first()[0]
    assert token_align.group_products(groups).count() == pairs


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \t\n▁ abcAB<s>|.,'01é中\U0001f600")), max_size=60), min_size=1, max_size=4))
def test_op13_cached_encoders_equal_the_libraries(texts):
    a, b = libraries()
    tokens = token_align.Tokens.get("byte_bpe_50k.json", "piece_bpe_32k.model")
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.b.encode(texts)] == [[] if "▁" in x else b.encode(x) for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.a.encode([" " + x for x in texts])] == [a.encode(" " + x, add_special_tokens=False).ids for x in texts]
