"""The corpus pipeline: toxicity, near copies, repeated passages, source mix and token ids, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import pipeline_stages as stages
from vecspark.llm.common import shared_path, ship_package

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("minhash_near_dedup", stages.drop_near_copies),
    ("substring_dedup", stages.drop_repeats),
    ("mixing", stages.mix_sources),
    ("sentencepiece", stages.encode),
]

#: Learned scores, sketches, automata and merges are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; every stage is written as Parquet to the shared folder and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
