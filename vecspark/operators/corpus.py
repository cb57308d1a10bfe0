"""Judgements, subsets, samples and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable_qrels(qrels: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Judgements with a positive score whose document and query exist."""
    return qrels.where("score > 0").join(corpus.select("doc_id").distinct(), "doc_id", "left_semi").join(queries.select("query_id").distinct(), "query_id", "left_semi")


def hash_order(column, seed):
    """A seeded order that other engines can follow."""
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f":{seed}")))


def preserving_subset(docs: DataFrame, positives: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """doc_id and is_positive: all positives, filled up to size documents in hash order."""
    keep = docs.select("doc_id").join(positives.select("doc_id").distinct(), "doc_id", "left_semi")
    n = keep.count()
    others = docs.select("doc_id").join(positives.select("doc_id").distinct(), "doc_id", "left_anti")
    fill = others.orderBy(hash_order("doc_id", seed), "doc_id").limit(max(0, size - n))
    return keep.withColumn("is_positive", F.lit(True)).unionAll(fill.withColumn("is_positive", F.lit(False)))


def stratified_sample(rows: DataFrame, by: str, n: int, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """At most n rows of each class in hash order, with rn and split (train or test)."""
    order = Window.partitionBy(by).orderBy(hash_order("doc_id", seed), "doc_id")
    picked = rows.withColumn("rn", F.row_number().over(order).cast("long")).where(F.col("rn") <= n)
    counts = rows.groupBy(by).agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("_n"))
    picked = picked.join(F.broadcast(counts), by)  # a row per class
    return picked.withColumn("split", F.when(F.col("rn") <= F.round(F.col("_n") * train_share), "train").otherwise("test")).drop("_n")


def integrity(docs: DataFrame, references: DataFrame) -> DataFrame:
    """(check_name, n): references without document, repeated ids, missing ids, and how far the numbers of documents and references differ."""
    missing = references.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    repeated = docs.groupBy("doc_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    nulls = docs.where("doc_id IS NULL").agg(F.count(F.lit(1)).alias("n"))
    named = lambda df, name: df.select(F.lit(name).alias("check_name"), "n")
    count = lambda df, sign: df.agg((F.count(F.lit(1)) * sign).alias("n"))
    differ = count(docs, 1).unionAll(count(references, -1)).agg(F.abs(F.sum("n")).alias("n"))
    return named(missing, "missing_documents").unionAll(named(repeated, "repeated_ids")).unionAll(named(nulls, "null_ids")).unionAll(named(differ, "count_mismatch"))


def require_count(df: DataFrame, expected: int, what: str) -> None:
    found = df.count()
    if found != expected:
        raise ValueError(f"Index/document mismatch: {what} has {found} rows, {expected} are expected")


def require_present(df: DataFrame, column: str, names: list[str]) -> None:
    have = {r[0] for r in df.where(F.col(column).isin(names)).select(column).distinct().collect()}  # at most as many as names
    if absent := [str(n) for n in names if n not in have]:
        raise ValueError(f"missing: {', '.join(absent)}")
