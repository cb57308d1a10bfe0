"""Scalar, vector and product quantisation, rotations and learned rotations.

Models are small (codebooks of m * k centroids, D x D rotations) and live on the driver as numpy arrays; vectors stay in
DataFrames and are read once per training step, each partition giving partial sums by (subspace, code)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from vecspark.functions.vector import EPS, normalize
from vecspark.operators.corpus import hash_order
from vecspark.operators.flat import _matrix

#: Bytes of distances that are held at once.
CHUNK_BYTES = 32 << 20


# --- scalar codes


def scalar_scale(vectors: DataFrame, bits: int) -> float:
    """max(|x|) / qmax over all components of x; 1 where all are zero."""
    top = vectors.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()[0] or 0.0
    return (top / (2 ** (bits - 1) - 1)) or 1.0


def scalar_codes(x, scale: float, bits: int):
    """Half-even rounding to clamped integers."""
    qmax = 2 ** (bits - 1) - 1
    return F.transform(x, lambda v: F.greatest(F.lit(-qmax), F.least(F.lit(qmax), F.rint(v / F.lit(scale)).cast("int"))))


def scalar_decode(codes, scale: float, unit: bool = True):
    y = F.transform(codes, lambda c: c.cast("double") * F.lit(scale))
    return normalize(y) if unit else y


def pack_codes(codes: np.ndarray, bits: int) -> bytes:
    """Integer codes of one vector as a bit string, low bits first."""
    unsigned = (codes.astype(np.int64) & ((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(((unsigned[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_codes(data: bytes, bits: int, n: int, signed: bool = True) -> np.ndarray:
    raw = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits).astype(np.int64)
    value = (raw << np.arange(bits)).sum(1)
    return np.where(value >= 1 << (bits - 1), value - (1 << bits), value) if signed else value


# --- product codes


@dataclass
class Codebook:
    centroids: np.ndarray  # m x k x (D / m)

    @property
    def m(self) -> int:
        return self.centroids.shape[0]

    @property
    def k(self) -> int:
        return self.centroids.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The nearest code of each subspace, ties to the lowest: |c|^2 - 2 x c by one matrix product a subspace and chunk.

        Where codes come so near that rounding could decide, their distances are summed from differences."""
        parts = x.reshape(len(x), self.m, -1)
        out = np.empty((len(x), self.m), np.int32)
        rows = max(1, CHUNK_BYTES // (8 * self.k))
        for j, centroids in enumerate(self.centroids):
            own = np.square(centroids).sum(1)
            for a in range(0, len(x), rows):
                part = parts[a : a + rows, j]
                far = own - 2.0 * (part @ centroids.T)
                code = far.argmin(1)
                near = far <= (np.take_along_axis(far, code[:, None], 1) + 1e-12 * (np.square(part).sum(1) + own.max())[:, None])
                for r in np.flatnonzero(near.sum(1) > 1).tolist():
                    some = np.flatnonzero(near[r])
                    code[r] = some[np.square(part[r] - centroids[some]).sum(1).argmin()]
                out[a : a + rows, j] = code
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centroids[np.arange(self.m)[None, :], codes].reshape(len(codes), -1)


def require_divisible(dimension: int, m: int) -> None:
    if dimension % m:
        raise ValueError(f"{dimension} dimensions cannot be cut into {m} equal parts")


def train_codebook(vectors: DataFrame, m: int, k: int, iterations: int = 3, seed: int = 42, tolerance: float = 0.0, refill: bool = False) -> Codebook:
    """Lloyd's algorithm in all subspaces at once: one pass over vectors (vec_id, x) an iteration.

    The first centroids are the first k vectors in hash order. An empty cluster keeps its centroid, or takes the next
    vectors in hash order with refill. Stops early when the relative shift is below the tolerance."""
    seeds = vectors.orderBy(hash_order("vec_id", seed), "vec_id").limit(k * (2 if refill else 1)).select("x").toArrow()
    x = _matrix(seeds["x"])
    vectors = vectors.select("vec_id", "x").persist()  # read again in every iteration
    if len(x) < k:
        raise ValueError(f"{k} clusters need at least {k} vectors, not {len(x)}")
    require_divisible(x.shape[1], m)
    book = Codebook(x[:k].reshape(k, m, x.shape[1] // m).transpose(1, 0, 2).copy())
    spare = x[k:].reshape(len(x) - k, m, x.shape[1] // m)
    for _ in range(iterations):
        sums, counts = _partial_sums(vectors, book)
        new = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], book.centroids)
        if refill:
            for j, c in zip(*np.nonzero(counts == 0)):
                if len(spare):
                    new[j, c] = spare[c % len(spare), j]
        shift = np.linalg.norm(new - book.centroids) / max(np.linalg.norm(book.centroids), EPS)
        book = Codebook(new)
        if shift < tolerance:
            break
    vectors.unpersist()
    return book


def _partial_sums(vectors: DataFrame, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts by (subspace, code): partial in each task, added up by Spark, at most m * k rows to the driver."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)
    m, k, d = book.centroids.shape

    def run(batches):
        own = shared.value
        sums, counts = np.zeros((m, k, d)), np.zeros((m, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            codes, parts = own.encode(x), x.reshape(len(x), m, d)
            for j in range(m):
                order = np.argsort(codes[:, j], kind="stable")
                used, begin, n = np.unique(codes[order, j], return_index=True, return_counts=True)
                sums[j, used] += np.add.reduceat(parts[order, j], begin)
                counts[j, used] += n
        j, c = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"j": pa.array(j, pa.int32()), "c": pa.array(c, pa.int32()), "n": pa.array(counts[j, c]), "s": pa.array(list(sums[j, c]), pa.list_(pa.float64()))})

    part = vectors.select("x").mapInArrow(run, "j int, c int, n double, s array<double>")
    added = part.groupBy("j", "c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s")).collect()
    sums, counts = np.zeros((m, k, d)), np.zeros((m, k))
    for r in added:
        sums[r.j, r.c], counts[r.j, r.c] = r.s, r.n
    return sums, counts


def encode(vectors: DataFrame, book: Codebook, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, the kept columns and codes of each row of vectors (vec_id, x); no shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes = shared.value.encode(_matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", *keep)), pa.array(list(codes), pa.list_(pa.int32()))], names=["vec_id", *keep, "codes"])

    schema = "vec_id long" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in vectors.select(*keep).schema) + ", codes array<int>"
    return vectors.select("vec_id", *dict.fromkeys((*keep, "x"))).mapInArrow(run, schema)


def decode(coded: DataFrame, book: Codebook, to: str = "y") -> DataFrame:
    """coded with a column more: the reconstruction of its codes, over Arrow with the codebook broadcast (m * k centroids)."""
    shared = coded.sparkSession.sparkContext.broadcast(book)
    schema = StructType([*coded.schema.fields, StructField(to, ArrayType(DoubleType()))])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(shared.value.decode(codes)), pa.list_(pa.float64()))], names=[*batch.schema.names, to])

    return coded.mapInArrow(run, schema)


def pack_rows(codes: np.ndarray, bits: int) -> np.ndarray:
    """Unsigned codes (rows, m) as rows of bytes, low bits first."""
    if bits == 8:
        return codes.astype(np.uint8)
    return np.packbits(((codes[:, :, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(len(codes), -1), axis=1, bitorder="little")


def unpack_rows(data: np.ndarray, bits: int, m: int) -> np.ndarray:
    """The codes (rows, m) of rows of bytes."""
    if bits == 8:
        return data.astype(np.int32)
    raw = np.unpackbits(data, axis=1, bitorder="little")[:, : m * bits].reshape(len(data), m, bits)
    return (raw.astype(np.int32) << np.arange(bits)).sum(2)


def codebook_rows(spark, book: Codebook) -> DataFrame:
    """(m, code, centroid) rows of a codebook."""
    return spark.createDataFrame([(j, c, v.tolist()) for j, part in enumerate(book.centroids) for c, v in enumerate(part)], "m int, code int, centroid array<double>")


# --- rotations


def random_rotation(dimension: int, seed: int = 42) -> np.ndarray:
    """The orthogonal factor of a seeded normal matrix, with a positive triangular diagonal."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def rotate(vectors: DataFrame, rotation: np.ndarray, inverse: bool = False) -> DataFrame:
    """vectors with x replaced by x R (or x R^T); the rotation is D x D, whatever the number of vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(rotation.T if inverse else rotation)
    at = vectors.columns.index("x")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column("x")) @ shared.value
                yield batch.set_column(at, "x", pa.array(list(y), pa.list_(pa.float64())))

    return vectors.mapInArrow(run, vectors.schema)


@dataclass
class LearnedRotation:
    rotation: np.ndarray
    book: Codebook
    distortions: list[float]
    orthogonality: list[float]


def learn_rotation(vectors: DataFrame, m: int, k: int, outer: int = 6, inner: int = 18, seed: int = 42) -> LearnedRotation:
    """Optimised product quantisation: product codes and the Procrustes rotation in turn, from the identity.

    Each outer step reads the vectors once more for the D x D product of vectors and reconstructions, summed in tasks."""
    d = vectors.select(F.size("x")).first()[0]
    rotation = np.eye(d)
    distortions, orthogonality = [], []
    for step in range(outer):
        turned = rotate(vectors.select("vec_id", "x"), rotation)
        book = train_codebook(turned, m, k, inner, seed + step)
        product, error, n = _procrustes_sums(vectors, rotation, book)
        distortions.append(error / max(n, 1))
        u, _, vt = np.linalg.svd(product)
        rotation = u @ vt
        orthogonality.append(float(np.linalg.norm(rotation.T @ rotation - np.eye(d))))
    book = train_codebook(rotate(vectors.select("vec_id", "x"), rotation), m, k, inner, seed)
    return LearnedRotation(rotation, book, distortions, orthogonality)


def _procrustes_sums(vectors: DataFrame, rotation: np.ndarray, book: Codebook) -> tuple[np.ndarray, float, int]:
    shared = vectors.sparkSession.sparkContext.broadcast((rotation, book))
    d = len(rotation)

    def run(batches):
        r, own = shared.value
        product, error, n = np.zeros((d, d)), 0.0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                turned = x @ r
                y = own.decode(own.encode(turned))
                product += x.T @ y
                error += float(np.square(turned - y).sum())
                n += len(x)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(d), pa.int32()), "p": pa.array(list(product), pa.list_(pa.float64())), "e": pa.array(np.full(d, error)), "n": pa.array(np.full(d, n), pa.int64())})

    part = vectors.select("x").mapInArrow(run, "i int, p array<double>, e double, n long")
    rows = part.groupBy("i").agg(F.array(*[F.sum(F.col("p")[j]) for j in range(d)]).alias("p"), F.sum("e").alias("e"), F.sum("n").alias("n")).orderBy("i").collect()  # D rows
    return np.array([r.p for r in rows]), rows[0].e, rows[0].n
