"""The encoder of whole texts: equal to the library, and the library gets each part once."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barwright.llm import common

PLAIN = Tokenizer.from_file(common.vocabulary_path())
PLAIN.encode_special_tokens = True
CACHED = common.Encoder()
WORDS = ["a", "the", "Word", "été", "Ñandú", "naïve×2", "÷", "don't", "'s", "'90s", "x" * 23, "x" * 24, "é" * 40, "12", "1234567", "ab12cd", "²", "ª", "ŏ", "ǆ", "мир", "źle", "αβ", "中文", "日本 語", "“q”", "\U0001f600", "é", "<|endoftext|>", "...", "?!", "'", '"\'s', "#'", "\x00", "\x7f", "_", "(", ")."]
GAPS = [" ", " ", " ", "", "\n", "\n\n", "  ", " \n", "\t", "\r\n", "\xa0", " ", "　", "\x85", "\x1c", "​", ", ", ".\n", "'"]


def equal(texts, encoder=CACHED):
    want = [PLAIN.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    whole = pa.array(["before", *texts, "after"])
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(whole.slice(1, len(texts)))] == want


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(WORDS) | st.sampled_from(GAPS), max_size=14).map("".join) | st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(GAPS)), max_size=8).map(lambda x: "".join(a + b for a, b in x)), max_size=5))
def test_equals_the_library(texts):
    equal(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_equals_the_library_on_any_text(texts):
    equal(texts)


def test_every_neighbour_of_a_space():
    """Every character below U+3100, before and after a space, before and after a line end, and within a word."""
    for text in (f"a{c} b {c}c{c}d\n{c} {c}\ne'{c}" for c in map(chr, [*range(0x3100), 0xFEFF, 0xFFFD])):
        assert np.frombuffer(CACHED.encode([text])[0], "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids, repr(text)


def test_after_the_table_is_emptied(monkeypatch):
    """Tables and the store of other pieces overflow again and again."""
    monkeypatch.setattr(common.Encoder, "ROOM", 5)
    monkeypatch.setattr(common.Encoder, "ODD", 2)
    encoder = common.Encoder()
    for n in range(30):
        equal([f"word{chr(97 + n % 26)} of {n} don't ,{'x' * n}\nnext", None, ""], encoder)


@pytest.mark.parametrize("n", [1, 3000, 70_000])
def test_table(n):
    """Keys that differ in one of three words, equal hashes included, while the table grows."""
    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate([rng.integers(1, 50, (n, 3)), rng.integers(1, 1 << 62, (n, 3))]).astype(np.uint64), axis=0)
    rng.shuffle(keys)
    counts = rng.integers(1, 25, len(keys))
    ids = rng.integers(0, 50_000, counts.sum()).astype(np.uint32)
    table, first = common.Table(4), np.cumsum(counts) - counts
    half = len(keys) // 2
    table.add(keys[:half], ids[: first[half]], counts[:half])
    assert not table.find(keys[half:]).any()
    table.add(keys[half:], ids[first[half] :], counts[half:])
    where = table.find(keys)
    assert (where & 255 == counts).all()
    for i in rng.integers(0, len(keys), 200):
        assert (table.pool[where[i] >> 8 :][: counts[i]] == ids[first[i] :][: counts[i]]).all()


def test_the_library_gets_every_part_once():
    """Words with all their ends of punctuation and lines cost the library no more than the words and the ends by themselves."""
    words = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in ("rn", "st", "lt", "ck")]
    ends = [a + b for a in ("", ".", ",", "?!", "***", ".%%%") for b in ("", "\nAnd", "\nOr")]
    encoder, given_to = common.Encoder(), []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            given_to.extend(texts)
            return PLAIN.encode_batch_fast(texts, **more)

    encoder.library = Counted()
    texts = ["Now " + " ".join(w + e for w in words) for e in ends]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [PLAIN.encode(x, add_special_tokens=False).ids for x in texts]
    assert sum(map(len, given_to)) <= sum(len(w) + 1 for w in words) + sum(map(len, ends)) + len("Now ")
