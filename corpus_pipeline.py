"""The training-data pipeline: documents in, token digests out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from needlestack.llm import stages
from needlestack.sources.scratch import materialize

STAGES = stages.STAGES
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written once and read as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
