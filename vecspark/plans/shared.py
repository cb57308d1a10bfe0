"""A folder that all executors share, for queries that write tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's spark.checkpoint.dir. Only a local session that names none gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='vecspark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path}/{name}-{uuid.uuid4().hex}"
