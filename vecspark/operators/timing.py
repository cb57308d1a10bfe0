"""Timed searches: warm-ups, full batches and repeated runs, around any search of a list of queries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.operators import reports

WARMUPS = 3


def timed_batches(search: Callable[[list], list], queries: list, batch: int, warmups: int = WARMUPS) -> tuple[list, list[tuple[int, float]]]:
    """All results in order, and (position, milliseconds) of the queries of full batches, each an equal share of its batch.

    An incomplete last batch is searched, not timed. Raises where no batch is full, or a search returns another number of items."""
    if batch < 1 or len(queries) < batch:
        raise ValueError(f"{len(queries)} queries don't fill a batch of {batch}")
    for _ in range(warmups):
        search(queries[:batch])
    results, timed = [], []
    for at in range(0, len(queries), batch):
        some = queries[at : at + batch]
        began = time.perf_counter()
        items = search(some)
        ms = (time.perf_counter() - began) * 1000
        if len(items) != len(some):
            raise ValueError(f"{len(items)} items for a batch of {len(some)} queries")
        results += items
        if len(some) == batch:
            timed += [(at + i, ms / batch) for i in range(batch)]
    return results, timed


def stability(spark: SparkSession, search: Callable[[list], list], queries: list, batches: tuple[int, ...] = (1, 8, 64), runs: int = 5) -> DataFrame:
    """Median, P10 and P90 over runs by batch size (a row each), of the queries that the driver holds and sends."""
    out = None
    for batch in batches:
        samples = [(run, position, ms) for run in range(runs) for position, ms in timed_batches(search, queries, batch)[1]]
        row = reports.batch_stability(spark.createDataFrame(samples, "run int, position int, ms double"), batch).withColumn("batch_size", F.lit(batch))
        out = row if out is None else out.unionByName(row)
    return out
