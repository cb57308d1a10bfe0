"""Inverted lists over product codes of residuals, searched through lookup tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.operators.flat import _matrix, blocks, ranked
from vecspark.operators.quantize import Codebook, pack_rows, train_codebook, unpack_rows

#: Queries are broadcast while their vectors, list scores and lookup tables (m * k doubles each) take no more bytes in a task.
QUERY_BYTES = 128 << 20
#: Lists up to so many are named in a filter, which prunes the folders of a saved index.
NAMED_LISTS = 10_000
SALT_ROWS = 65_536
#: Bytes of lookup tables and of hits that a task holds at once.
TABLE_BYTES = 16 << 20


@dataclass
class IvfPq:
    coarse: np.ndarray  # nlist x D
    book: Codebook
    by_residual: bool = True

    @property
    def bits(self) -> int:
        return max(1, (self.book.k - 1).bit_length())

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The list with the highest inner product, ties to the lowest."""
        return (x @ self.coarse.T).argmax(1)


def train(vectors: DataFrame, nlist: int, m: int, k: int, iterations: int = 3, seed: int = 42, by_residual: bool = True, sample: DataFrame | None = None) -> IvfPq:
    sample = vectors if sample is None else sample
    coarse = train_codebook(sample, 1, nlist, iterations, seed).centroids[0]
    index = IvfPq(coarse, Codebook(np.zeros((1, 1, coarse.shape[1]))), by_residual)
    index.book = train_codebook(residuals(sample, index), m, k, iterations, seed)
    return index


def residuals(vectors: DataFrame, index: IvfPq) -> DataFrame:
    """(vec_id, list_id, x): vectors less the centroid of their list."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                lists = own.assign(x)
                rest = x - own.coarse[lists] if own.by_residual else x
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(lists, pa.int32()), pa.array(list(rest), pa.list_(pa.float64()))], names=["vec_id", "list_id", "x"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, list_id int, x array<double>")


def postings(vectors: DataFrame, index: IvfPq) -> DataFrame:
    """(vec_id, list_id, codes) of all vectors, codes packed to ceil(log2 k) bits; no shuffle. Written partitioned by list_id, searches prune it."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                lists = own.assign(x)
                codes = own.book.encode(x - own.coarse[lists] if own.by_residual else x)
                packed = pack_rows(codes, own.bits)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(lists, pa.int32()), pa.array([r.tobytes() for r in packed], pa.binary())], names=["vec_id", "list_id", "codes"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, list_id int, codes binary")


@dataclass
class Probes:
    """Queries with their best lists and lookup tables: one table a query, whatever its lists."""

    ids: np.ndarray
    lists: np.ndarray  # queries x nprobe
    base: np.ndarray  # inner products with the centroids of these lists
    tables: np.ndarray  # queries x m x k

    @classmethod
    def of(cls, index: IvfPq, ids: np.ndarray, q: np.ndarray, nprobe: int) -> Probes:
        m, k, d = index.book.centroids.shape
        s = q @ index.coarse.T
        lists = np.argsort(-s, axis=1, kind="stable")[:, :nprobe]
        base = np.take_along_axis(s, lists, 1) if index.by_residual else np.zeros(lists.shape)
        return cls(ids, lists, base, np.einsum("nmd,mkd->nmk", q.reshape(len(q), m, d), index.book.centroids))

    @classmethod
    def parts(cls, index: IvfPq, ids: np.ndarray, q: np.ndarray, nprobe: int, k: int) -> Iterator[Probes]:
        """The same for some queries at a time: their tables, list scores and hits take at most TABLE_BYTES each."""
        m, width, _ = index.book.centroids.shape
        step = max(1, TABLE_BYTES // (8 * max(m * width, len(index.coarse), 3 * min(nprobe, len(index.coarse)) * k)))
        for a in range(0, len(ids), step):
            yield cls.of(index, ids[a : a + step], q[a : a + step], nprobe)

    def best(self, vec_ids: np.ndarray, list_ids: np.ndarray, codes: np.ndarray, k: int) -> pa.Table:
        """The k best of some postings for each query that probes their lists."""
        order = np.argsort(list_ids, kind="stable")
        used, begin = np.unique(list_ids[order], return_index=True)
        by_list = np.argsort(self.lists, axis=None, kind="stable")
        first = np.searchsorted(self.lists.ravel()[by_list], np.append(used, used + 1)).reshape(2, -1)
        found = []
        for start, stop, rows in zip(*first.tolist(), np.split(order, begin[1:])):
            asked, probe = np.divmod(by_list[start:stop], self.lists.shape[1])
            for a in range(0, asked.size, max(1, (16 << 20) // (8 * rows.size))):
                some = asked[a : a + max(1, (16 << 20) // (8 * rows.size))]
                score = np.repeat(self.base[some, probe[a : a + some.size], None], rows.size, 1)
                for j in range(codes.shape[1]):
                    score += self.tables[some, j][:, codes[rows, j]]
                n = min(k, rows.size)
                least = np.partition(score, rows.size - n, axis=1)[:, rows.size - n, None]
                r, c = np.nonzero(score >= least)
                found.append((some[r], vec_ids[rows[c]], score[r, c]))
        q, v, s = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        keep = np.arange(q.size) - np.searchsorted(q, q) < k
        return pa.table({"query_id": pa.array(self.ids[q[keep]], pa.int64()), "vec_id": pa.array(v[keep], pa.int64()), "score": pa.array(s[keep], pa.float64())})


def probes(queries: DataFrame, index: IvfPq, nprobe: int) -> DataFrame:
    """(query_id, list_id, base): the nprobe best lists of each query (query_id, q)."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                s = _matrix(batch.column("q")) @ own.coarse.T
                lists = np.argsort(-s, axis=1, kind="stable")[:, :nprobe]
                base = np.take_along_axis(s, lists, 1) if own.by_residual else np.zeros(lists.shape)
                ids = np.repeat(batch.column("query_id").to_numpy(), lists.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists.ravel(), pa.int32()), pa.array(base.ravel())], names=["query_id", "list_id", "base"])

    return queries.select("query_id", "q").mapInArrow(run, "query_id long, list_id int, base double")


def _codes(column, index: IvfPq) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = -(-index.book.m * index.bits // 8)
    return unpack_rows(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width), index.bits, index.book.m)


SCORED = "query_id long, vec_id long, score double"


def search(queries: DataFrame, lists: DataFrame, index: IvfPq, nprobe: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) by asymmetric distances over packed postings, with a partial top k per batch; nprobe belongs to the call.

    While all queries fit QUERY_BYTES they are broadcast, and only the lists they probe are read. Beyond, queries and the
    postings of their lists meet by list, in groups of bounded size."""
    m, width, d = index.book.centroids.shape
    nprobe = min(nprobe, len(index.coarse))
    each = 8 * (m * width + len(index.coarse) + m * d)
    if queries.count() * each <= QUERY_BYTES:
        asked = queries.select("query_id", "q").toArrow()  # a checked number of bytes
        if not asked.num_rows:
            return queries.sparkSession.createDataFrame([], "query_id long, rank long, vec_id long, score double")
        ids, q = asked["query_id"].to_numpy(), _matrix(asked["q"])
        probed = np.unique(np.concatenate([np.unique(p.lists) for p in Probes.parts(index, ids, q, nprobe, k)]))
        if probed.size < min(NAMED_LISTS, len(index.coarse)):
            lists = lists.where(F.col("list_id").isin(probed.tolist()))
        shared = queries.sparkSession.sparkContext.broadcast((index, ids, q))

        def run(batches):
            own, ids, q = shared.value
            for t in blocks(batches, SALT_ROWS):
                vec_ids, list_ids, codes = t["vec_id"].to_numpy(), t["list_id"].to_numpy(), _codes(t["codes"], own)
                for asked in Probes.parts(own, ids, q, nprobe, k):
                    yield from asked.best(vec_ids, list_ids, codes, k).to_batches()

        return ranked(lists.select("vec_id", "list_id", "codes").mapInArrow(run, SCORED), k)
    shared = queries.sparkSession.sparkContext.broadcast(index)
    groups = max(1, -(-queries.count() * each // QUERY_BYTES))
    met = probes(queries, index, nprobe).select("query_id", "list_id").join(queries.select("query_id", "q"), "query_id")
    met = met.withColumn("grp", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    salts = lists.groupBy("list_id").agg((F.floor(F.count(F.lit(1)) / SALT_ROWS) + 1).alias("salts"))
    met = met.join(salts, "list_id").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    wanted = met.select(F.col("list_id").alias("list_id"), F.col("grp").alias("grp")).distinct()
    dealt = lists.join(salts, "list_id").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts"))).join(wanted, "list_id")

    def pair(key, left, right):
        own = shared.value
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        vec_ids, list_ids, codes = right["vec_id"].to_numpy(), right["list_id"].to_numpy(), _codes(right["codes"], own)
        return pa.concat_tables(asked.best(vec_ids, list_ids, codes, k) for asked in Probes.parts(own, left["query_id"].to_numpy(), _matrix(left["q"]), nprobe, k))

    keys = ("list_id", "grp", "salt")
    left, right = met.select(*keys, "query_id", "q").groupBy(*keys), dealt.select(*keys, "vec_id", "codes").groupBy(*keys)
    return ranked(left.cogroup(right).applyInArrow(pair, SCORED), k)
