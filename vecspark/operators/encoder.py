"""Text to vectors. The encoder is an interface: any function of (rows, id, text) to (id, x) serves.

The default needs no model: words are hashed to buckets, counted and scaled to unit length, over Arrow without a shuffle."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from vecspark.functions.vector import EPS

DIMENSION = 64
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MEMO_WORDS = 200_000
#: Rows that are encoded at once; their texts are unpacked one by one.
SLICE = 256


def hash_encode(rows: DataFrame, id_column: str, text_column: str, dimension: int = DIMENSION) -> DataFrame:
    """(id, x) of each row; a text without words gets the zero vector. A word's bucket is its md5's first 32 bits modulo the dimension."""
    rows = rows.select(id_column, F.lower(F.coalesce(text_column, F.lit(""))).alias("_text"))
    schema = StructType([rows.schema.fields[0], StructField("x", ArrayType(DoubleType()))])

    def run(batches):
        memo: dict[str, int] = {}
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):
                batch = whole.slice(a, SLICE)
                counts = np.zeros((batch.num_rows, dimension))
                for row, text in enumerate(batch.column("_text")):
                    if len(memo) > MEMO_WORDS:
                        memo.clear()
                    buckets = []
                    for match in WORD.finditer(text.as_py()):
                        word = match.group()
                        bucket = memo.get(word)
                        if bucket is None:
                            bucket = memo[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % dimension
                        buckets.append(bucket)
                    counts[row] = np.bincount(buckets, minlength=dimension) if buckets else 0
                x = counts / np.maximum(np.sqrt(np.square(counts).sum(1)), EPS)[:, None]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=[id_column, "x"])

    return rows.mapInArrow(run, schema)
