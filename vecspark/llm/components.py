"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a partial aggregation and an equi-join, of tables that are materialised once a star, so hubs are combined before the shuffle
and split by the adaptive skew join; no neighbourhood is ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import cut


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _to_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least of u and all its v as m."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (u, v long), the component being its least node."""
    directed = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = cut(directed.distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        small = _to_least(large)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = cut(small.where("u <> v").distinct())
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
