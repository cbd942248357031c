"""The corpus pipeline: documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import stages
from quillstack.llm.common import materialize, read

#: (name, function); each takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("quality_rules", stages.quality_rules),
    ("exact_dedup", stages.exact_dedup),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("secret_scans", stages.secret_scans),
    ("best_fit_packing", stages.best_fit_packing),
]

#: The likelihood ratio, the randomness tests and the packing have no SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written as Parquet before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
