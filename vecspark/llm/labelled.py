"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id, parts: int):
    """crc32 of the doc_id as text, modulo parts."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, text, y, weight) of at most per_class labelled rows of each class outside the held-out fold.

    The rows are those with the smallest hash of doc_id, so the sample is the same in every run; weight is the number
    of labelled rows that each stands for. Labels that are null or neither 0 nor 1 are left out; of labels of one
    doc_id that differ the more frequent one counts, and 0 where both are as frequent."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held))
    usable = usable.select("doc_id", F.col(label).cast("int").alias("y"))
    usable = usable.groupBy("doc_id").agg(F.when(F.avg("y") > 0.5, 1).otherwise(0).alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    picked = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    weight = F.when(F.col("y") == 1, max(1.0, counts.get(1, 0) / per_class)).otherwise(max(1.0, counts.get(0, 0) / per_class))
    picked = picked[0].unionAll(picked[1]).withColumn("weight", weight)
    # at most 2 * per_class rows of some 30 bytes are broadcast; texts are not shuffled
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
