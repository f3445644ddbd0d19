import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"w{i % 997}x{i // 7}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(70))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "alpha beta gamma delta epsilon zeta", None, "a"),
    (4, LONG, "en", "a"), (4, LONG, "en", "a"), (5, LONG + " tail", "de", "a"), (6, " \t\n\x0b\x0c\r ", "en", None), (7, "é ü 中文  x  1 2\n\n3", None, "é"),
    (8, "12 34 !!", "en", "c"), (9, PASSAGE, "en", "c"), (10, "before " + PASSAGE + " after", "en", "c"), (11, "password = hunter2hunter2 " + PASSAGE, "en", None),
    (12, "ALPHA beta gamma delta epsilon zeta", "de", "b"), (13, LONG, "en", "a"), (None, None, None, None),
]
#: Names that the operators use themselves.
CLASHES = "n_words size target start length rank score component_id rep key one copy places h1 sig bits toxic held_out".split()


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """A folder of tables with nulls in every column, empty and long texts, repeated rows and clashing extra columns."""
    at = tmp_path_factory.mktemp("edge")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.withColumns({c: F.lit("x") for c in CLASHES}).write.parquet(f"{at}/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (4, None, 0), (None, 0, 1), (9, 0, 1), (11, 0, 1)], "doc_id long, quality int, toxic int")
    labels.withColumn("text", F.lit("x")).write.parquet(f"{at}/labels.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (None, [1.0, 0.0]), (50, [1.0, 0.01]), (100, [-1.0, 0.0]), (9, [1.0, 0.0]), (150, [0.0, 0.0])]
    vectors = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "v": F.lit(2), "cell": F.lit(3), "n": F.lit(4)})
    vectors.write.parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.fixture(scope="session")
def empty(spark, edge, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{edge}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return str(at)

