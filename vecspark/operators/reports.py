"""Storage formulas, latency summaries, frontiers and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def storage(configs: DataFrame) -> DataFrame:
    """Analytical and serialised bytes and ratios of configurations.

    configs: method, kind (float32, scalar, pq, ivfpq), n, d, bits, m, k, nlist, rotated boolean, ids_again boolean."""
    n, d, m, k = (F.col(c).cast("double") for c in ("n", "d", "m", "k"))
    kind = F.col("kind")
    code_bits = F.when(kind == "scalar", n * d * F.col("bits")).otherwise(n * m * F.ceil(F.log2(k)).cast("double"))
    payload = F.when(kind == "float32", n * d * 4).otherwise(F.ceil(code_bits / 8).cast("double"))
    book = F.when(kind == "scalar", F.lit(4.0)).when(kind == "float32", F.lit(0.0)).otherwise(k * d * 4)
    turn = F.when(F.col("rotated"), d * d * 4).otherwise(0.0)
    lists = F.when(kind == "ivfpq", F.col("nlist") * d * 4 + n * 8).otherwise(0.0)
    again = F.when(F.col("ids_again"), n * 8 + 128).otherwise(0.0)
    long = lambda c: c.cast("long")
    out = configs.select(
        "method", long(n * d * 4).alias("float32_bytes"), long(payload).alias("payload_bytes"), long(payload + book).alias("format_bytes"),
        long(payload + book + turn).alias("deployment_bytes"), long(payload + book + turn + lists + again).alias("serialized_bytes"),
    )
    ratio = lambda c: F.round(F.col("float32_bytes") / F.col(c), 4)
    return out.withColumns({f"{p}_ratio": ratio(f"{p}_bytes") for p in ("payload", "format", "deployment", "serialized")})


def server_latency(endpoint, latency_ms, latency_ms_total):
    """The latency that a response states: that of the query for /search, that of the whole batch otherwise."""
    return F.when(endpoint == "/search", latency_ms).otherwise(latency_ms_total)


def latency_summary(samples: DataFrame) -> DataFrame:
    """Percentiles, means and throughput of request samples by endpoint and batch size."""
    pct = lambda c, p: F.expr(f"percentile({c}, {p})")
    return samples.groupBy("endpoint", "batch_size").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("batch_size").cast("long").alias("total_queries"),
        pct("client_latency_ms", 0.5).alias("client_p50_ms"), pct("client_latency_ms", 0.95).alias("client_p95_ms"), F.avg("client_latency_ms").alias("client_mean_ms"),
        pct("server_latency_ms", 0.5).alias("server_p50_ms"), pct("server_latency_ms", 0.95).alias("server_p95_ms"),
        (F.sum("batch_size") * 1000.0 / F.sum("client_latency_ms")).alias("query_throughput_qps"),
    )


def batch_stability(samples: DataFrame, batch: int) -> DataFrame:
    """Timings (run, position, ms) in batches by position; incomplete last batches aren't timed. Median, P10 and P90 over runs."""
    place = F.row_number().over(Window.partitionBy("run").orderBy("position")) - 1
    batches = samples.withColumn("batch_id", F.floor(place / batch)).groupBy("run", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms")).where(F.col("n") == batch)
    runs = batches.groupBy("run").agg(F.expr(f"percentile(ms / {batch}, 0.5)").alias("p50"), F.expr(f"percentile(ms / {batch}, 0.95)").alias("p95"), (F.sum("n") * 1000.0 / F.sum("ms")).alias("qps"), F.sum("n").alias("timed"))
    stats = [F.expr(f"percentile({c}, {p})").alias(f"{c}_{name}") for c in ("p50", "p95", "qps") for p, name in ((0.5, "median"), (0.1, "p10"), (0.9, "p90"))]
    return runs.agg(*stats, F.count(F.lit(1)).alias("runs"), F.max("timed").alias("timed_queries"))


def frontier(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other dominates when both columns are to be high; ties survive.

    One row per distinct x passes through the running maximum, so the self join of the definition is not needed."""
    best = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("_x")).agg(F.max(y).alias("_y"))
    before = Window.partitionBy(F.lit(0)).orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_above", F.max("_y").over(before)).where(F.col("_above").isNull() | (F.col("_y") > F.col("_above"))).drop("_above")
    return rows.join(best, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))).drop("_x", "_y")


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with rows of new in place of those with the same key; columns are aligned by name."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def placed(rows: DataFrame, *order) -> DataFrame:
    """rows of a report table with their place (from 1) in an order; a row per method passes one task."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def best_methods(rows: DataFrame, floor: float) -> DataFrame:
    """(choice, method): best recall, best ratio, best balance, and the most compressed method with recall over floor."""
    pick = lambda by, where=F.lit(True): F.max_by("method", F.when(where, by))
    out = rows.agg(
        pick(F.struct("recall", "ratio")).alias("best_recall"), pick(F.struct("ratio", "recall")).alias("best_ratio"),
        pick(F.struct(F.col("ratio") * F.col("recall"), F.col("ratio"))).alias("best_balance"), pick(F.struct("ratio", "recall"), F.col("recall") >= floor).alias("practical"),
    )
    return out.unpivot([], ["best_recall", "best_ratio", "best_balance", "practical"], "choice", "method")
