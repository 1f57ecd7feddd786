"""The corpus pipeline: quality filter, exact dedup, near dedup, mixing and tokens, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import bpe, exact_dedup, mixing, near_dedup, quality
from trawl.scratch import materialise

STAGES = [
    ("quality_classifier", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("source_mixing", mixing.stage),
    ("byte_bpe", bpe.stage),
]

#: Classifier scores, sketches and tokens are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each stage's result written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else materialise(out, f"stage-{name}")
    return docs
