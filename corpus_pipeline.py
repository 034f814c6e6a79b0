"""The documents of a corpus, stage by stage: toxic documents go, then exact and near copies, the rest is mixed to
target weights and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table, written
from tessera.llm.exact_dedup import keep_unique
from tessera.llm.mixing import mixed_documents
from tessera.llm.near_dedup import keep_distinct
from tessera.llm.pieces import encoded
from tessera.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: drop_toxic(docs, table(spark, sf_dir, "labels"))),
    ("exact_dedup", lambda spark, docs, sf_dir: keep_unique(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: keep_distinct(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixed_documents(docs)),
    ("sentencepiece", lambda spark, docs, sf_dir: encoded(docs)),
]
#: A trained classifier, signatures and piece paths: not in SQL. tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each reading what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
