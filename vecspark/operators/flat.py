"""Exact inner-product search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries are broadcast up to so many rows (at 1,024 dimensions 80 MB); beyond, blocks of both sides meet by key.
BROADCAST_QUERIES = 10_000
#: Rows and bytes of a block of vectors; bytes of the scores, and rows of candidates, that a task holds at once.
BLOCK, BLOCK_BYTES, SCORE_BYTES, CANDIDATES = 65_536, 32 << 20, 32 << 20, 4_096
#: Pairs of a group of blocks that meet.
PAIRS = 1 << 31


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = a * 134217729.0
    high = t - (t - a)
    return high, a - high


def _fused(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a * b + c rounded once (Boldo and Melquiond: the low parts are added to odd)."""
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    low = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    th, tl = _two_sum(c, low)
    vh, vl = _two_sum(p, th)
    z, e = _two_sum(tl, vl)
    bits = z.view(np.int64)
    step = np.where((e > 0) == (z > 0), 1, -1)
    z = np.where((e != 0) & (bits & 1 == 0), bits + step, bits).view(np.float64)
    r = vh + z
    return np.where(np.isfinite(r), r, p + c)


def sequential(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, summed in vector order by fused steps as in DuckDB's list_inner_product: they don't depend on
    how rows were dealt to blocks, and scores that are equal but for rounding come in the order of the SQL."""
    with np.errstate(all="ignore"):
        if all((v == v.astype(np.float32)).all() for v in (q, x)):  # products are exact
            return np.cumsum(q * x, axis=-1)[..., -1] if q.shape[-1] else np.zeros(len(q))
        out = np.zeros(len(q))
        for u, v in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(x.T)):
            out = _fused(u, v, out)
    return out


def _least(s: np.ndarray, n: int) -> np.ndarray:
    """A bound that at least n scores of each row reach: the n-th of the maxima of groups of columns, or of all."""
    width = s.shape[1] // 64
    if width >= 4 * n:
        s = s[:, : 64 * width].reshape(len(s), 64, width).max(1)
    return np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n, None]


def _early(ids: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Which rows are among the n smallest ids of their exact copies: no other can be among the n best."""
    x = np.ascontiguousarray(x)
    copies = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, copies))
    early = np.empty(len(ids), bool)
    early[order] = np.arange(len(ids)) - np.searchsorted(copies[order], copies[order]) < n
    return early


def _best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool) -> Iterator[pa.RecordBatch]:
    """The k best rows of a block for each query, some queries at a time, so that scores take at most SCORE_BYTES. A matrix product
    picks the candidates, with all that come near the k-th; their scores are then summed in vector order."""
    n, early = min(k, len(ids)), None
    if not n:
        return
    longest = max(np.linalg.norm(x, axis=1).max(), 1e-300)
    by_id = np.argsort(ids, kind="stable")
    often = np.unique(ids, return_counts=True)[1].max() if exclude_self else 0
    step = max(1, SCORE_BYTES // (8 * len(ids)))
    for a in range(0, len(q), step):
        part, part_ids = q[a : a + step], query_ids[a : a + step]
        s = part @ x.T
        size = np.linalg.norm(part, axis=1)[:, None] * longest
        if not np.isfinite(size).all():
            s[~np.isfinite(s)] = -np.inf
        if exclude_self:
            first, end = np.searchsorted(ids, part_ids, "left", by_id), np.searchsorted(ids, part_ids, "right", by_id)
            own = np.repeat(np.arange(len(part)), end - first)
            s[own, by_id[np.repeat(first, end - first) + np.arange(own.size) - np.searchsorted(own, own)]] = -np.inf
        row, column = np.nonzero((s >= _least(s, n) - 1e-12 * size) & np.isfinite(s))
        if row.size > 8 * n * len(part):
            early = _early(ids, x, n + often) if early is None else early
            row, column = row[early[column]], column[early[column]]
        score = np.empty(row.size)
        for b in range(0, row.size, CANDIDATES):
            score[b : b + CANDIDATES] = sequential(part[row[b : b + CANDIDATES]], x[column[b : b + CANDIDATES]])
        order = np.lexsort((ids[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        keep = np.arange(row.size) - np.searchsorted(row, row) < n
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(part_ids[row[keep]], pa.int64()), "vec_id": pa.array(ids[column[keep]], pa.int64()), "score": pa.array(score[keep], pa.float64())})


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Arrow batches gathered or cut to tables of up to so many rows."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def top_k(queries: DataFrame, docs: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """queries (query_id, q) against docs (vec_id, x): matrix products over blocks of vectors, with a partial top k per block before the shuffle.

    Up to BROADCAST_QUERIES queries are broadcast; beyond, blocks of both sides, of bounded rows and bytes, meet by key. Their
    number follows from the pairs, so that each side is sent about as often as the square root of it."""
    schema = "query_id long, vec_id long, score double"
    rows = queries.select("query_id", "q").limit(BROADCAST_QUERIES + 1).toArrow()
    if not rows.num_rows:
        return docs.sparkSession.createDataFrame([], "query_id long, rank long, vec_id long, score double")
    held = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, _matrix(rows["q"].slice(0, 1)).shape[1]))))
    if rows.num_rows <= BROADCAST_QUERIES:
        shared = docs.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), _matrix(rows["q"])))

        def run(batches):
            ids, q = shared.value
            for t in blocks(batches, held):
                yield from _best(t["vec_id"].to_numpy(), _matrix(t["x"]), ids, q, k, exclude_self)

        return ranked(docs.select("vec_id", "x").mapInArrow(run, schema), k)
    n_docs, n_queries = max(1, docs.count()), queries.count()
    met = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-n_docs * n_queries // PAIRS))
    q_groups = max(-(-n_queries // held), min(met, round((met * n_queries / n_docs) ** 0.5)), 1)
    d_groups = max(-(-n_docs // held), min(n_docs, -(-met // q_groups)))
    number = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>"))
    d = docs.select("vec_id", "x", F.pmod(F.xxhash64("vec_id"), F.lit(d_groups)).alias("dg")).withColumn("qg", number(q_groups))
    q = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(q_groups)).alias("qg")).withColumn("dg", number(d_groups))

    def pair(key, left, right):
        found = _best(left["vec_id"].to_numpy(), _matrix(left["x"]), right["query_id"].to_numpy(), _matrix(right["q"]), k, exclude_self) if left.num_rows and right.num_rows else ()
        return pa.Table.from_batches(found, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    dealt = lambda df: df.repartition(min(q_groups * d_groups, 2_000), "dg", "qg").groupBy("dg", "qg")
    return ranked(dealt(d).cogroup(dealt(q)).applyInArrow(pair, schema), k)
