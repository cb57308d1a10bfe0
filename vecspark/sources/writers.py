"""Sinks for tables, documents and small reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep="\t")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_text(spark: SparkSession, text: str, path: str, mode: str = "overwrite") -> None:
    """A small report as one text file, through Spark so that any store serves."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).option("lineSep", "\n").text(path)


def write_json_document(spark: SparkSession, value: dict, path: str, mode: str = "overwrite") -> None:
    write_text(spark, json.dumps(value, sort_keys=True), path, mode)


def read_json_document(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def markdown(df: DataFrame) -> str:
    """A report table (collected: use it on result tables only)."""
    rows = [df.columns, ["---"] * len(df.columns), *([("" if v is None else str(v)) for v in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"
