"""The retrieval service: single and batch search over a saved index or plain vectors, and health."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.operators import artifact, flat, ivf
from vecspark.operators.encoder import hash_encode
from vecspark.operators.quantize import rotate

MAX_CHARS, MAX_TOP_K, MAX_NPROBE, MAX_QUERIES = 2000, 20, 256, 32
#: Hits of up to some 100 bytes each, and their queries of up to MAX_CHARS, are broadcast to the documents.
BROADCAST_HITS = 10_000


def validate(queries: list[str], top_k: int = 5, nprobe: int | None = None) -> None:
    if not queries:
        raise ValueError("no query given")
    if len(queries) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} queries a batch")
    if any(not q or len(q) > MAX_CHARS for q in queries):
        raise ValueError(f"a query has 1 to {MAX_CHARS} characters")
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k is 1 to {MAX_TOP_K}")
    if nprobe is not None and not 1 <= nprobe <= MAX_NPROBE:
        raise ValueError(f"nprobe is 1 to {MAX_NPROBE}")


def search_texts(queries: DataFrame, documents: DataFrame, top_k: int, encoder: Callable = hash_encode, search: Callable | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """queries (pos, text) against documents (vec_id, doc_id, title, text): pos, query, rank, score, doc_id, title, text.

    All queries are encoded and searched at once; rows keep pos, the order of the input. The vectors (vec_id, x; of documents
    where none are given) are searched by themselves, and only hits are joined to titles and texts."""
    asked = encoder(queries, "pos", "text").withColumnsRenamed({"pos": "query_id", "x": "q"})
    found = search(asked, top_k) if search else flat.top_k(asked, documents.select("vec_id", "x") if vectors is None else vectors, top_k)
    named = found.join(queries.select(F.col("pos").alias("query_id"), F.col("text").alias("query")), "query_id")
    if queries.count() * top_k <= BROADCAST_HITS:
        named = F.broadcast(named)  # a checked number of hits
    hits = documents.select("vec_id", "doc_id", "title", F.col("text").alias("document")).join(named, "vec_id")
    return hits.select(F.col("query_id").alias("pos"), "query", "rank", "score", "doc_id", "title", F.col("document").alias("text"))


class Retriever:
    """Answers searches; nprobe is an argument of each call, so no call changes another."""

    def __init__(self, spark: SparkSession, path: str | None = None, documents: DataFrame | None = None, encoder: Callable = hash_encode, model: str = "hash"):
        self.spark, self.path, self.encoder, self.model = spark, path, encoder, model
        self.documents, self.index, self.lists, self.rotation = documents, None, None, None
        self.manifest = {"index_type": "flat", "default_nprobe": None}

    @property
    def is_ready(self) -> bool:
        return self.documents is not None and (self.path is None or self.index is not None)

    def load(self) -> Retriever:
        if self.path is not None:
            self.index, self.lists, self.documents, self.rotation, self.manifest = artifact.load(self.spark, self.path)
        return self

    def _search(self, nprobe: int | None):
        if self.index is None:
            return None

        def run(asked: DataFrame, k: int) -> DataFrame:
            if self.rotation is not None:
                asked = rotate(asked.withColumnRenamed("q", "x"), self.rotation).withColumnRenamed("x", "q")
            return ivf.search(asked, self.lists, self.index, nprobe, k)

        return run

    def search_many(self, queries: list[str], top_k: int = 5, nprobe: int | None = None) -> dict:
        if not self.is_ready:
            raise RuntimeError("the service is not ready")
        validate(queries, top_k, nprobe)
        nprobe = nprobe or self.manifest["default_nprobe"]
        began = time.perf_counter()
        asked = self.spark.createDataFrame(list(enumerate(queries)), "pos long, text string")
        rows = search_texts(asked, self.documents, top_k, self.encoder, self._search(nprobe)).orderBy("pos", "rank").collect()  # at most 32 x 20
        ms = (time.perf_counter() - began) * 1000
        hits = lambda i: [{"rank": r.rank, "score": r.score, "doc_id": r.doc_id, "title": r.title, "text": r.text} for r in rows if r.pos == i]
        common = {"top_k": top_k, "nprobe": nprobe, "index_type": self.manifest["index_type"], "query_transform_enabled": self.rotation is not None}
        items = [{"query": q, **common, "results": hits(i)} for i, q in enumerate(queries)]
        return {"count": len(queries), **common, "latency_ms_total": round(ms, 3), "latency_ms_per_query": round(ms / len(queries), 3), "items": items}

    def search(self, query: str, top_k: int = 5, nprobe: int | None = None) -> dict:
        many = self.search_many([query], top_k, nprobe)
        return {**many["items"][0], "latency_ms": many["latency_ms_total"]}

    def health(self) -> DataFrame:
        if not self.is_ready:
            return self.spark.createDataFrame([("not ready", None, None, None)], "status string, index_type string, model string, documents long")
        return self.documents.agg(F.count(F.lit(1)).alias("documents")).select(
            F.lit("ok").alias("status"), F.lit(self.manifest["index_type"]).alias("index_type"), F.lit(self.model).alias("model"), "documents"
        )
