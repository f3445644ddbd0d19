"""Numbered operators on cases beyond the generated tables."""

import random

from barwright.llm import langid


def test_op3_finds_more_than_four_languages(spark):
    rng, letters = random.Random(2), ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    text = lambda own, n: " ".join("".join(rng.choice(own) for _ in range(6)) for _ in range(n))
    docs = spark.createDataFrame([(k * 100 + i, text(own, 200), own) for k, own in enumerate(letters) for i in range(6)], "doc_id long, text string, lang string")
    mixed = spark.createDataFrame([(1, " ".join(text(own, 60) for own in letters[:5]))], "doc_id long, text string")
    found = langid.detect(mixed, *langid.fit(docs)).first()
    assert set(found["mixture"]) == set(letters[:5])
    assert all(abs(p - 0.2) < 0.02 for p in found["mixture"].values()) and abs(found["score"] - 0.2) < 0.02
