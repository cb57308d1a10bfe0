"""Saved indexes: a folder of Parquet tables and a manifest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from vecspark.operators.ivf import IvfPq
from vecspark.operators.quantize import Codebook, codebook_rows
from vecspark.sources.writers import read_json_document, write_json_document

PARTS = ("coarse", "codebook", "postings", "documents", "manifest")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stored_bytes(spark: SparkSession, path: str) -> dict[str, int]:
    """Measured bytes of each part of a saved index."""
    files = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
    at = [(name, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")) for name in (*PARTS, "rotation")]
    return {name: files(p).getContentSummary(p).getLength() for name, p in at if files(p).exists(p)}


def save(spark: SparkSession, path: str, index: IvfPq, lists: DataFrame, documents: DataFrame, rotation: np.ndarray | None = None, nprobe: int = 4, mode: str = "errorifexists", **facts) -> None:
    """Write all parts; postings are partitioned by list_id, so that probes read only their lists."""
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.coarse)], "list_id int, centroid array<double>").write.mode(mode).parquet(f"{path}/coarse")
    codebook_rows(spark, index.book).write.mode(mode).parquet(f"{path}/codebook")
    lists.repartition("list_id").write.mode(mode).partitionBy("list_id").parquet(f"{path}/postings")
    documents.write.mode(mode).parquet(f"{path}/documents")
    if rotation is not None:
        spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rotation)], "row int, coeffs array<double>").write.mode(mode).parquet(f"{path}/rotation")
    manifest = {
        "version": 1, "index_type": "ivfpq", "vector_count": lists.count(), "dimension": int(index.coarse.shape[1]), "default_nprobe": nprobe, "normalization": "l2",
        "by_residual": index.by_residual, "query_transform": {"enabled": rotation is not None, "shape": list(rotation.shape) if rotation is not None else None}, **facts,
    }
    write_json_document(spark, manifest, f"{path}/manifest")


def load(spark: SparkSession, path: str) -> tuple[IvfPq, DataFrame, DataFrame, np.ndarray | None, dict]:
    """(index, postings, documents, rotation, manifest); one error names all missing parts."""
    missing = [f"{path}/{p}" for p in PARTS if not exists(spark, f"{path}/{p}")]
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))
    manifest = read_json_document(spark, f"{path}/manifest")
    coarse = np.array([r.centroid for r in spark.read.parquet(f"{path}/coarse").orderBy("list_id").collect()])  # nlist rows
    rows = spark.read.parquet(f"{path}/codebook").orderBy("m", "code").collect()  # m * k rows
    m = rows[-1].m + 1
    book = Codebook(np.array([r.centroid for r in rows]).reshape(m, len(rows) // m, -1))
    rotation = None
    if manifest["query_transform"]["enabled"]:
        if not exists(spark, f"{path}/rotation"):
            raise FileNotFoundError(f"missing: {path}/rotation")
        rotation = np.array([r.coeffs for r in spark.read.parquet(f"{path}/rotation").orderBy("row").collect()])  # D rows
        if rotation.shape != (manifest["dimension"],) * 2:
            raise ValueError(f"the rotation has shape {rotation.shape}, not {manifest['dimension']} square")
        if (error := float(np.linalg.norm(rotation.T @ rotation - np.eye(len(rotation))))) > 1e-6:
            raise ValueError(f"the rotation is not orthogonal: off by {error}")
    documents = spark.read.parquet(f"{path}/documents")
    lists = spark.read.parquet(f"{path}/postings").select("vec_id", "list_id", "codes")
    for name, df in (("documents", documents), ("postings", lists)):
        if (n := df.count()) != manifest["vector_count"]:
            raise ValueError(f"Index/document mismatch: {name} has {n} rows, the manifest says {manifest['vector_count']}")
    return IvfPq(coarse, book, manifest["by_residual"]), lists, documents, rotation, manifest
