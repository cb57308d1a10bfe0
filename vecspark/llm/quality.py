"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A document's terms are pairs of neighbouring character shapes, word-level repetition bands and hashed words. Counts
are damped, weighted by inverse document frequency and scaled within each of the three groups; a truncated singular
value decomposition of a bounded labelled sample gives the latent space. The labelled vectors are broadcast (a fixed
number of rows), every document's cosine with all of them is computed in exact blocked matrix products, and the
nearest ones vote with their similarity.

Edge cases: a null or empty text has a zero vector and gets the sample's mean label; texts are read whole; repeated
rows score alike; with no usable labels every score is 0.5; of references as similar as the last one that votes those of
smaller doc_id vote; each vote also has the weight of its row in the labelled sample, so that a bounded sample of a large
class counts for the whole class; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import slices, span_hashes, table, text_bytes, words_of
from vecspark.llm.labelled import fold, training_rows

PARTS, HELD = 3, 1
THRESHOLD = 0.5
TRAIN_PER_CLASS = 2_048  # bound of the labelled sample, for each class: at most 4,096 broadcast vectors
DIMENSIONS = 32
NEIGHBOURS = 15
BLOCK = 1_024

#: Character shapes: one for each ASCII punctuation mark, and one each for the classes below.
SHAPES = 40
BANDS = 12
WORD_BUCKETS = 1_024
GROUPS = (SHAPES * SHAPES, 6 * BANDS, WORD_BUCKETS)
GROUP_WEIGHTS = (1.0, 1.0, 0.35)
FEATURES = sum(GROUPS)


def _shapes() -> np.ndarray:
    shape = np.full(256, 0, np.uint8)
    shape[128:] = 1
    for b in range(128):
        c = chr(b)
        shape[b] = 2 if c.islower() else 3 if c.isupper() else 4 if c.isdigit() else 5 if c == "\n" else 6 if c.isspace() else 7 if b < 32 or b == 127 else 0
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    shape[marks] = [8 + k for k in range(len(marks))]
    return shape


_SHAPE = _shapes()


def _per_text(keys: np.ndarray, doc: np.ndarray, n: int, size: int) -> np.ndarray:
    return np.bincount(doc * size + keys, minlength=n * size).reshape(n, size).astype(np.float32)


def term_counts(texts: pa.Array) -> np.ndarray:
    """Damped term counts of each text, its groups side by side."""
    raw, offsets = text_bytes(texts)
    n = len(offsets) - 1
    shape = np.minimum(_SHAPE[raw], SHAPES - 1).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    inside = doc[1:] == doc[:-1]
    pairs = _per_text((shape[:-1] * SHAPES + shape[1:])[inside], doc[1:][inside], n, GROUPS[0])
    starts, lengths, first = words_of(raw, offsets)
    count = np.diff(first)
    word_doc = np.repeat(np.arange(n), count)
    hashes = span_hashes(raw, starts, lengths) if starts.size else np.empty(0, np.uint64)
    buckets = _per_text((hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), word_doc, n, WORD_BUCKETS)
    # shares that tell repetition and odd words, each as a band of its value
    total = np.maximum(count, 1)
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])) if hashes.size else np.empty(0, bool)
    again = np.bincount(word_doc, weights=same, minlength=n) / total
    order = np.lexsort((hashes, word_doc))
    new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (word_doc[order][1:] != word_doc[order][:-1])) if hashes.size else np.empty(0, bool)
    distinct = np.bincount(word_doc[order], weights=new, minlength=n) / np.sqrt(total * 4.0)
    size = np.maximum(np.diff(offsets), 1)
    share = lambda kinds: np.bincount(doc, weights=np.isin(shape, kinds), minlength=n) / size
    long_words = np.bincount(word_doc, weights=lengths > 24, minlength=n) / total
    values = np.stack([again, np.minimum(distinct, 1), share([3]), share(list(range(8, SHAPES))), share([4]), long_words], 1)
    band = np.minimum((np.sqrt(values) * BANDS).astype(np.int64), BANDS - 1)
    bands = np.zeros((n, GROUPS[1]), np.float32)
    for k in range(6):
        bands[np.arange(n), k * BANDS + band[:, k]] = 1.0
    bands[count == 0] = 0
    return np.concatenate([np.sqrt(pairs), bands, np.log1p(buckets)], 1)


@dataclass
class Model:
    idf: np.ndarray  # FEATURES
    basis: np.ndarray  # FEATURES x DIMENSIONS
    vectors: np.ndarray  # unit rows, at most 2 * TRAIN_PER_CLASS
    votes: np.ndarray  # label of each reference, 0 or 1
    weights: np.ndarray  # labelled rows that each reference stands for, 1 on average
    prior: float


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf
    at = 0
    for size, weight in zip(GROUPS, GROUP_WEIGHTS):
        part = x[:, at : at + size]
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        at += size
    return x


def project(counts: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    v = _weighted(counts, idf) @ basis
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def fit(counts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """idf and basis from the damped counts of the labelled sample, by the eigenvectors of its term products."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    x = _weighted(counts, idf)
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = vectors[:, ::-1][:, :DIMENSIONS]
    scale = 1 / np.sqrt(np.maximum(values[::-1][:DIMENSIONS], 1e-9) / len(x) + 1e-3)  # evens out the leading directions
    return idf, (basis * scale).astype(np.float32)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest values of each row, ties to the smaller column."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    bound = np.take_along_axis(cosine, near, 1).min(1)
    for r in np.flatnonzero((cosine >= bound[:, None]).sum(1) > k):  # more rows tie with the last one than there is room for
        tied, above = np.flatnonzero(cosine[r] == bound[r]), np.flatnonzero(cosine[r] > bound[r])
        near[r] = np.concatenate([above, tied[: k - above.size]])
    return near


def vote(model: Model, vectors: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest references, by exact blocked cosines."""
    out = np.full(len(vectors), model.prior)
    k = min(NEIGHBOURS, len(model.vectors))
    for a in range(0, len(vectors), BLOCK):
        block = vectors[a : a + BLOCK]
        cosine = block @ model.vectors.T
        near = nearest(cosine, k)
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0.0) ** 4 * model.weights[near]
        ones = model.votes[near]
        total = weight.sum(1)
        known = (total > 0) & (np.abs(block).sum(1) > 0)
        out[a : a + BLOCK][known] = ((weight * ones).sum(1)[known] + 0.01 * model.prior) / (total[known] + 0.01)
    return out


def train_model(docs: DataFrame, labels: DataFrame) -> Model | None:
    rows = training_rows(docs, labels, "quality", PARTS, HELD, TRAIN_PER_CLASS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", max_bytes=1 << 20):
            counts = term_counts(part.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "y": part.column("y"), "weight": part.column("weight"), "counts": [x.astype(np.float16).tobytes() for x in counts]})

    # a bounded sample: at most 4,096 rows of some 5 kB
    got = rows.select("doc_id", "text", "y", "weight").mapInArrow(run, "doc_id long, y int, weight double, counts binary").toArrow().sort_by([("doc_id", "ascending")])
    if not got.num_rows:
        return None
    counts = np.stack([np.frombuffer(x, np.float16) for x in got["counts"].to_pylist()]).astype(np.float32)
    y, weight = got["y"].to_numpy().astype(float), got["weight"].to_numpy()
    idf, basis = fit(counts, y)
    prior = float((y * weight).sum() / weight.sum())
    return Model(idf, basis, project(counts, idf, basis), y, weight / weight.mean(), prior)


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id, text); no shuffle."""
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    parts = (model.idf, model.basis, model.vectors, model.votes, model.weights, model.prior)
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # at most 4,096 x 32 floats and a basis of 2,700 x 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for part in slices(batches, "text", max_bytes=2 << 20):
            for a in range(0, part.num_rows, BLOCK):  # counts of many short texts stay small
                block = part.slice(a, BLOCK)
                counts = term_counts(block.column("text"))
                empty = counts.sum(1) == 0
                vectors = project(counts, own.idf, own.basis)
                vectors[empty] = 0
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(vote(own, vectors), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, train_model(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id", (fold(F.col("doc_id"), PARTS) == HELD).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
