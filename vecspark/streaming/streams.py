"""Streams: encode and append new vectors, and search arriving queries against stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.vector import doubles
from vecspark.operators import ivf
from vecspark.operators.flat import top_k
from vecspark.operators.quantize import scalar_codes

VECTORS = "vec_id long, embedding array<float>, label int"


def vector_stream(spark: SparkSession, path: str) -> DataFrame:
    """Vectors that arrive as Parquet files in a folder; a single file is a folder of that name only."""
    reader = spark.readStream.schema(VECTORS).option("maxFilesPerTrigger", 64)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        folder, _, name = path.rpartition("/")
        rows = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        rows = reader.parquet(path)
    return rows.select("vec_id", doubles("embedding").alias("x"))


def append_codes(stream: DataFrame, out: str, checkpoint: str, scale: float, bits: int = 8):
    """Encode vectors with a fixed scale and append them as Parquet; exactly once by the sink's log. Runs all that is there."""
    codes = stream.select("vec_id", scalar_codes(F.col("x"), scale, bits).alias("codes"))
    query = codes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_postings(stream: DataFrame, index: ivf.IvfPq, out: str, checkpoint: str):
    """Assign, encode and append vectors (vec_id, x) to the inverted lists at out; exactly once by the sink's log. Runs all that is there."""
    rows = ivf.postings(stream, index)
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("list_id").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def search_stream(stream: DataFrame, docs: DataFrame, k: int, out: str, checkpoint: str):
    """Search each micro-batch of queries (vec_id, x); a replayed batch overwrites its own folder, so results stay whole."""

    def run(batch: DataFrame, number: int) -> None:
        asked = batch.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
        top_k(asked, docs, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
