"""A corpus pipeline of the numbered operators: documents that are toxic go, one of each group of near copies stays,
secrets are blotted out, the sources are mixed to their target weights, and the mix is packed into token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Near copies have 0.8 or more of their five-word shingles in common.

Edge cases: a null text counts as empty, is no near copy of anything, holds no secret, and packs as one token; rows with a null
id stay where ids decide; rows that repeat an id are documents of their own, which come after all others among near
copies; an empty table goes through as empty; extra columns are carried along to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwright.llm import jaccard, mixing, packing, secrets, toxicity
from barwright.llm.common import table, write_shared


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near copies", near_copy_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Segment scans, joins on similarity and tokenisation are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
