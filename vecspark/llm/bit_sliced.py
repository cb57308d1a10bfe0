"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers. The index holds, for each block of rows, one bitmap per attribute and bit. A
query adds attribute slices with bitmap arithmetic only: its weights are taken bit by bit from the top, all attributes
with that bit are summed by carry-save adders over whole slices, and negative weights use the complement of an
attribute (which shifts all scores of the query alike). Of the summed scores the k best rows are selected from
the most significant slice downward; rows that tie at the boundary are resolved exactly, smaller vec_id first.

Every query meets every block once: query groups and blocks meet by equal keys (block, group), with bounded sizes of
both, so nothing is broadcast and no pair of rows leaves a task unless it is among a block's k best.

Edge cases: null vectors and those with null, NaN or infinite components, and rows without vec_id, take no part; shorter
vectors count as padded with zeros; rows that repeat a vec_id are queries of their own, and candidates of each other: each
such query gives its k rows under the same query_id; components so large that a sum of products may leave 64 bits raise a
ValueError before the search; a query without candidates gives no row; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.llm.common import cut, table

BLOCK_ROWS = 32_768
QUERY_GROUP, LEAST_GROUP = 4_096, 256  # queries that meet a block together; fewer only while tasks would be too few
SCALE = 64
TOP_K = 20
EVERY = 20
CHUNK = "block long, n long, ids binary, numbers binary, slices binary"
FOUND = "asked long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q array<bigint>) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("q"))


def _matrix(t: pa.Table, size: int) -> np.ndarray:
    lists = t.column("q").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), size), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def build_slices(values: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (attribute, bit, words) of non-negative values (row, attribute)."""
    words = -(-len(values) // 64)
    padded = np.zeros((words * 64, values.shape[1]), np.int64)
    padded[: len(values)] = values
    bits = (padded.T[:, None, :] >> np.arange(width)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)


def ripple_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two stacks of slices, one slice wider than the wider one."""
    n = max(len(a), len(b)) + 1
    out = np.zeros((n, a.shape[1]), np.uint64)
    carry = np.zeros(a.shape[1], np.uint64)
    for i in range(n):
        if i < len(a) and i < len(b):
            half = a[i] ^ b[i]
            out[i] = half ^ carry
            carry = (a[i] & b[i]) | (half & carry)
        elif i < len(a) or i < len(b):
            one = a[i] if i < len(a) else b[i]
            out[i] = one ^ carry
            carry = one & carry
        else:
            out[i] = carry
    return out


def add_slices(stacks: list[np.ndarray]) -> np.ndarray:
    """Sum of many stacks of equal width by carry-save adders over whole stacks."""
    width, words = stacks[0].shape
    n = width + len(stacks).bit_length()
    total, carry = np.zeros((n, words), np.uint64), np.zeros((n, words), np.uint64)
    half, both = np.empty_like(total), np.empty_like(total)
    for x in stacks:
        np.bitwise_xor(total, carry, out=half)
        np.bitwise_and(total, carry, out=both)
        both[:width] |= half[:width] & x
        np.copyto(total, half)
        total[:width] ^= x
        carry[1:] = both[:-1]
        carry[0] = 0
    return ripple_add(total, carry)


def scores(slices: np.ndarray, flipped: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slices of sum(weight * attribute) for each row, up to a constant of the query."""
    size = np.abs(weights)
    out = np.zeros((1, slices.shape[2]), np.uint64)
    for bit in range(int(size.max(initial=0)).bit_length() - 1, -1, -1):
        out = np.concatenate([np.zeros((1, out.shape[1]), np.uint64), out])
        some = np.flatnonzero((size >> bit) & 1)
        if some.size:
            out = ripple_add(out, add_slices([slices[j] if weights[j] > 0 else flipped[j] for j in some.tolist()]))
    return out


def select_top(total: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k rows of the bitmap rows with the highest sums, ties to smaller numbers."""
    sure, open_ = np.zeros_like(rows), rows.copy()
    for s in total[::-1]:
        both = open_ & s
        n = int(np.bitwise_count(sure).sum() + np.bitwise_count(both).sum())
        if n > k:
            open_ = both
        else:
            sure |= both
            open_ &= ~s
            if n == k:
                open_[:] = 0
                break
    numbers = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    chosen = numbers(sure)
    return np.concatenate([chosen, numbers(open_)[: k - chosen.size]])


def top_k(vectors: DataFrame, queries, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of vectors (vec_id, q) for each of its rows that the condition queries holds for, itself left out."""
    vectors = cut(vectors.select("vec_id", "q").withColumn("row", F.monotonically_increasing_id()))
    seen = vectors.select("vec_id", F.array_min("q").alias("low"), F.array_max("q").alias("high"), F.size("q").alias("d"))
    facts = seen.agg(F.count(F.lit(1)), F.min("low"), F.max("high"), F.max("d"), F.count_if(queries)).first()  # five numbers
    n, low, high, size, n_queries = facts[0], min(0, facts[1] or 0), max(0, facts[2] or 0), max(1, facts[3] or 0), facts[4]
    if size * max(-low, high) ** 2 >= 1 << 63:
        raise ValueError(f"components from {low} to {high} in {size} dimensions: inner products may exceed 64 bits")
    span = high - low
    width = max(1, int(span).bit_length())
    blocks = max(1, -(-n // BLOCK_ROWS))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n_queries // QUERY_GROUP), min(-(-n_queries // LEAST_GROUP), -(-2 * cores // blocks)))

    def index(key, t):
        t = t.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        ids, numbers = t.column("vec_id").to_numpy(), t.column("row").to_numpy()
        slices = build_slices(_matrix(t, size) - low, width)
        return pa.table({
            "block": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([ids.size], pa.int64()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
            "numbers": pa.array([numbers.astype("<i8").tobytes()], pa.binary()), "slices": pa.array([slices.tobytes()], pa.binary()),
        })

    def search(key, block, asked):
        found = []
        if block.num_rows and asked.num_rows:
            ids, numbers = (np.frombuffer(block.column(c)[0].as_py(), "<i8") for c in ("ids", "numbers"))
            place = dict(zip(numbers.tolist(), range(numbers.size)))
            slices = np.frombuffer(block.column("slices")[0].as_py(), np.uint64).reshape(size, width, -1)
            every = np.zeros(slices.shape[2] * 64, np.uint8)
            every[: ids.size] = 1
            rows = np.packbits(every, bitorder="little").view(np.uint64)
            # span - value, slice by slice
            flipped = np.stack([_subtracted(span, s, rows) for s in slices])
            for row, query, weights in zip(asked.column("row").to_pylist(), asked.column("vec_id").to_pylist(), _matrix(asked, size)):
                own = rows
                if (r := place.get(row)) is not None:
                    own = rows.copy()
                    own[r // 64] &= ~np.uint64(1 << (r % 64))
                best = select_top(scores(slices, flipped, weights), own, k)
                bits = (slices[:, :, best // 64] >> (best % 64).astype(np.uint64)) & np.uint64(1)
                values = (bits.astype(np.int64) << np.arange(width)[None, :, None]).sum(1) + low
                found.append((np.full(best.size, row), np.full(best.size, query), ids[best], weights @ values))
        columns = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("asked", "query_id", "vec_id", "score"), columns)})

    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>"))
    sliced = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).groupBy("block").applyInArrow(index, CHUNK)
    sliced = sliced.withColumn("grp", numbers(groups)).select("block", "grp", "ids", "numbers", "slices")
    asked = vectors.where(queries).withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups))).withColumn("block", numbers(blocks))
    found = sliced.groupBy("block", "grp").cogroup(asked.select("block", "grp", "row", "vec_id", "q").groupBy("block", "grp")).applyInArrow(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _subtracted(span: int, value: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Slices of span - value (never negative) on the rows of the bitmap."""
    out = np.empty_like(value)
    borrow = np.zeros_like(rows)
    for i in range(len(value)):
        top = rows if (span >> i) & 1 else np.zeros_like(rows)
        out[i] = (top ^ value[i] ^ borrow) & rows
        borrow = (~top & (value[i] | borrow)) | (value[i] & borrow)
    return out


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, F.pmod("vec_id", F.lit(EVERY)) == 0, TOP_K)


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.r <> b.r
), t AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""
