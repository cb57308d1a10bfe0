"""Corpus operators as pipeline stages: (spark, docs, sf_dir) to a DataFrame.

All stages but the last return rows with the columns of documents (doc_id, text, lang, source, n_chars, and any others).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import table
from vecspark.llm.minhash import deduplicate
from vecspark.llm.mixing import mix
from vecspark.llm.sentencepiece_bpe import encode_documents, model_bytes
from vecspark.llm.substring_dedup import remove_repeats
from vecspark.llm.toxicity import score_documents, train_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject; its model learns from the corpus as it came in."""
    model = train_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_documents(docs, model, tuple(docs.columns)).where("_tox_predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    return deduplicate(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start earlier in the corpus; n_chars follows the text."""
    out = remove_repeats(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each document of the mix."""
    return encode_documents(docs, model_bytes())
