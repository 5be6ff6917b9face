"""Clean a corpus and encode it: five stages, each written as Parquet and read by the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the last return the
columns of ``docs``. Toxic documents go, one document of each near-duplicate group stays,
documents that hold a benchmark window go, secrets are masked in the texts, and what is left
is encoded. Columns beyond those of ``documents`` pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import stages
from veilspark.llm.storage import kept

STAGES = [
    ("toxicity", stages.without_toxic),
    ("near_duplicates", stages.one_of_each_group),
    ("decontamination", stages.without_benchmark),
    ("secrets", stages.with_secrets_masked),
    ("encoding", stages.encoded),
]

ORACLE_SQL = None  # the first stage is a learnt model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
