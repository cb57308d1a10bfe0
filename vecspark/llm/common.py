"""What the corpus operators share: tables, lineage cuts and Arrow batch slicing."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session that names none gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='vecspark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that lost executors cost no recomputation of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in a folder of this driver's within the shared one; the folder goes when the driver ends."""
    sc = spark.sparkContext
    if not getattr(sc, "_vecspark_scratch", None):
        sc._vecspark_scratch = f"{shared_dir(spark)}/vecspark-{uuid.uuid4().hex}"
        p = spark._jvm.org.apache.hadoop.fs.Path(sc._vecspark_scratch)
        files = p.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(p)
        files.deleteOnExit(p)
    return f"{sc._vecspark_scratch}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def n_words(col) -> F.Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], *columns: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about max_bytes of the text columns (a longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        part = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    release()


def release() -> None:
    """Give memory that is free back to the system, so that a worker of several tasks stays small."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@functools.cache
def _trim():
    """The C library's malloc_trim where it has one."""
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column (null: empty) and the offsets of each text in them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def binaries(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of flat[offsets[i]:offsets[i + 1]]."""
    width = flat.dtype.itemsize
    flat = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())]
    )


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    kind = np.int32 if total < 1 << 31 and (not starts.size or int(starts.max()) + int(lengths.max()) < 1 << 31) else np.int64
    if not total:
        return np.empty(0, kind)
    keep = lengths > 0
    if not keep.all():
        starts, lengths = starts[keep], lengths[keep]
    out = np.ones(total, kind)
    out[0] = starts[0]
    out[np.cumsum(lengths)[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out, dtype=kind, out=out)


_POWERS = np.ones(1, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2 ** 64."""
    global _POWERS
    if _POWERS.shape[-1] < n or _POWERS.ndim == 1:
        size = max(n, 1 << 16)
        both = np.empty((2, size), np.uint64)
        both[:, 0] = 1
        both[0, 1:], both[1, 1:] = _BASE, _INVERSE
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(both, axis=1, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span values[start:start + length], by prefix sums of a polynomial over mixed values."""
    with np.errstate(over="ignore"):
        up, down = _powers(values.size + 1)
        sums = np.empty(values.size + 1, np.uint64)
        sums[0] = 0
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * down[: values.size], dtype=np.uint64, out=sums[1:])
        h = (sums[starts + lengths] - sums[starts]) * up[starts]
        return mix64(h + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def distinct_spans(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a representative of each distinct span, number of its representative for each span); exact."""
    hashes = span_hashes(values, starts, lengths)
    while True:
        inverse, unique = pd.factorize(hashes)
        rep = np.empty(len(unique), np.int64)
        rep[inverse[::-1]] = np.arange(inverse.size - 1, -1, -1)  # the first one stays
        own, other = ragged(starts, lengths), ragged(starts[rep][inverse], np.minimum(lengths, lengths[rep][inverse]))
        if own.size == other.size and (lengths == lengths[rep][inverse]).all() and (values[own] == values[other]).all():
            return rep, inverse
        hashes = np.array([hash(values[a : a + n].tobytes()) for a, n in zip(starts.tolist(), lengths.tolist())], np.int64)  # spans of equal hash differ


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words in the texts raw[offsets[i]:offsets[i + 1]], and the first word of each text (one more at the end)."""
    inside = np.zeros(raw.size + 2, bool)
    inside[1:-1] = (raw != 0x20) & ((raw < 9) | (raw > 13))
    edge = inside[1:] & ~inside[:-1]
    cut_at = offsets[(offsets > 0) & (offsets < raw.size)]
    edge[cut_at] |= inside[cut_at + 1]
    starts = np.flatnonzero(edge)
    stop = inside[:-1] & ~inside[1:]
    stop[cut_at] |= inside[cut_at]
    ends = np.flatnonzero(stop)
    return starts, ends - starts, np.searchsorted(starts, offsets)


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package as an archive, where neither PYTHONPATH nor the working folder has it."""
    import os
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    found = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if str(root) in found or getattr(sc, "_vecspark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="vecspark-")) / "vecspark_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.joinpath("vecspark").rglob("*.py")):
            z.write(path, path.relative_to(root))
    sc.addPyFile(str(archive))
    sc._vecspark_shipped = True
