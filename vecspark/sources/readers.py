"""Readers of corpora, queries, judgements and driver tables. A malformed JSON line or number fails the read; blank lines and short rows are skipped as documented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(c):
    return F.regexp_replace(c, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def title_and_text(title, text):
    """Title, newline and text without outer white space; nulls count as empty."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """{_id, title?, text} lines, blank ones skipped, as doc_id, title, text and body."""
    rows = spark.read.schema("_id string, title string, text string").json(path, mode="FAILFAST").where("_id IS NOT NULL")
    return rows.select(F.col("_id").alias("doc_id"), "title", "text", title_and_text(F.col("title"), F.col("text")).alias("body"))


def read_queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("_id string, text string").json(path, mode="FAILFAST").where("_id IS NOT NULL")
    return rows.select(F.col("_id").alias("query_id"), "text")


def read_qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated judgements with a header: query-id, corpus-id, score."""
    rows = spark.read.schema("q string, d string, s int").csv(path, sep="\t", header=True, mode="FAILFAST")
    return rows.toDF("query_id", "doc_id", "score")


def read_trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgements `qid 0 pid rel` without header; short rows and those without relevance are left out."""
    rows = spark.read.schema("q string, z string, d string, s int").csv(path, sep="\t")
    return rows.where("d IS NOT NULL AND s > 0").select(F.col("q").alias("query_id"), F.col("d").alias("doc_id"), F.lit(1).alias("score"))


def read_key_value_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Lines cut once at their first tab."""
    rows = spark.read.text(path).where("value <> ''")
    parts = F.split("value", "\t", 2)
    return rows.select(parts[0].alias("key"), F.get(parts, 1).alias("text"))


def read_document_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CORPUS).json(path, mode="FAILFAST").where("doc_id IS NOT NULL")


def read_with_fallback(spark: SparkSession, readers: list) -> DataFrame:
    """The first of several readers (callables of a session) whose source exists."""
    from pyspark.errors import AnalysisException

    for k, reader in enumerate(readers):
        try:
            return reader(spark)
        except AnalysisException:
            if k == len(readers) - 1:
                raise
    raise ValueError("no reader given")
