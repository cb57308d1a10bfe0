"""Token-id files with keyed access through minimal perfect hashes.

`write_tokens` sorts documents by doc_id and writes containers: rows of a Parquet folder, each a row group of its own, that
hold the raw little-endian ids of some MB of text (payload: uint16 where the vocabulary allows, else uint32), the lengths
of its documents and their keys. `write_index` maps each distinct doc_id to the place of its first row: container, offset
and length in ids, ordinal in all files, and the number of its rows. Keys are dealt by hash to buckets of bounded size,
and every bucket is a minimal perfect hash of cascaded bit arrays (keys that collide at a level go to the next one) with a
32-bit fingerprint stored by slot. A key is found by its bucket, at most a few bit probes, one rank and one fingerprint
comparison: constant time, whatever the corpus. `fetch` reads the ids of some keys from their containers alone.
Spark writes and commits all files, so lost executors leave no half-written ones, and any Spark-readable store serves.

Edge cases: a null text has no ids but the end id; a null doc_id is kept under the smallest long; rows that repeat a
doc_id are all kept, side by side, in order of a hash of their texts, and may lie in several containers; an absent key is
reported as not found (a fingerprint that agrees by accident is settled by the keys stored with the ids, which `verified`
and `fetch` compare); an empty table gives empty files and an empty result; extra columns are ignored. A text of any
length stays in one container.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.llm.common import binaries, distinct_spans, mix64, ragged, shared_path, slices, table, text_bytes, words_of

END_ID = 1
NULL_KEY = -(2**63)
BUCKET_KEYS = 65_536
CONTAINER_BYTES = 4 << 20
MEMO_UNITS = 600_000  # of a generation; a worker holds two, some 200 MB
ENCODE_UNITS = 16_384  # in one call of the library
CHUNKS = 1 << 24  # containers of a partition at most
CONTAINERS = "container long, part int, n_docs long, n_tokens long, keys binary, lengths binary, payload binary"
PLACE = ("ordinal", "container", "offset", "length", "n")
INDEX = "bucket long, n_keys long, level_bits binary, levels binary, prints binary, places binary"


# --- tokens


class WordEncoder:
    """Encodes batches with a tokenizers file whose pre-tokenizer drops white space; and remembers distinct parts of words.

    The memo has two generations: a full one becomes the old one, from which a part that comes again moves to the new one.
    So frequent parts stay, however much text a worker reads."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        kind = np.full(256, 3, np.uint8)  # 0: white space, 1: ASCII letter, 2: other ASCII, 3: not ASCII
        kind[:128] = 2
        kind[65:91] = kind[97:123] = 1
        kind[9:14] = kind[32] = 0
        self.kind = kind
        self.edge = np.zeros((4, 4), bool)
        self.edge[1, 2] = self.edge[2, 1] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.fresh()
        self.old = self.memo, self.ids, self.at

    def fresh(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.ids, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each."""
        raw, offsets = text_bytes(texts)
        starts, lengths, _ = words_of(raw, offsets)
        if not starts.size:
            return np.empty(0, np.uint32), np.zeros(offsets.size, np.int64)
        # ASCII letters and other ASCII characters never share a token, unless for contractions and special tokens
        marks = np.flatnonzero((raw == 0x27) | (raw == 0x7C))
        whole = np.searchsorted(marks, starts + lengths) > np.searchsorted(marks, starts) if marks.size else np.zeros(starts.size, bool)
        kind = self.kind[raw]
        split = np.zeros(raw.size, bool)
        split[1:] = self.edge[kind[1:], kind[:-1]]  # never at white space
        low = self.lower[raw]
        if marks.size:
            as_is = ragged(starts[whole], lengths[whole])
            low[as_is] = raw[as_is]
            split[as_is] = False
        split[starts] = True
        begins = np.flatnonzero(split)
        word = np.searchsorted(starts, begins, "right") - 1
        sizes = np.minimum(np.append(begins[1:], raw.size), (starts + lengths)[word]) - begins
        rep, inverse = distinct_spans(low, begins, sizes)
        blob = low.tobytes()
        known = self.lookup([blob[a : a + n] for a, n in zip(begins[rep].tolist(), sizes[rep].tolist())])[inverse]
        n = np.diff(self.at)[known]
        total = np.append(0, np.cumsum(n))
        return self.ids[ragged(self.at[known], n)], total[np.searchsorted(begins, offsets)]

    def lookup(self, units: list[bytes]) -> np.ndarray:
        """The number of each of these distinct units in the memo, which learns the new ones."""
        if self.memo and len(self.memo) + len(units) > MEMO_UNITS:
            self.old = self.memo, self.ids, self.at
            self.fresh()
        known = list(map(self.memo.get, units))
        unseen = [i for i, k in enumerate(known) if k is None]
        if not unseen:
            return np.array(known, np.int64)
        memo, old_ids, old_at = self.old
        before = np.array([memo.get(units[i], -1) for i in unseen], np.int64)
        order = np.argsort(before < 0, kind="stable")  # those of the old generation first
        moved = before[order[: np.count_nonzero(before >= 0)]]
        unseen = [unseen[i] for i in order.tolist()]
        new, base = [units[i] for i in unseen], len(self.memo)
        n = np.diff(old_at)[moved]
        ids, counts = [self.ids, old_ids[ragged(old_at[moved], n)]], [np.diff(self.at), n]
        for a in range(moved.size, len(new), ENCODE_UNITS):
            some = new[a : a + ENCODE_UNITS]
            got = self.tokenizer.encode([u.decode() for u in some], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, np.uint32))
            counts.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))
        self.memo.update(zip(new, range(base, base + len(new))))
        self.ids, self.at = np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(counts)))
        for number, i in enumerate(unseen):
            known[i] = base + number
        return np.array(known, np.int64)


_ENCODERS: dict[int, WordEncoder] = {}


def worker_encoder(spec: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker, so that its memo serves them all."""
    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]


def write_tokens(docs: DataFrame, spec: str, path: str, end_id: int = END_ID) -> None:
    """Write docs (doc_id, text) as containers to path, in ascending doc_id order."""
    from tokenizers import Tokenizer

    narrow = max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1) <= 1 << 16
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # a file of some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        part = TaskContext.get().partitionId()
        for chunk, batch in enumerate(slices(batches, "text", max_bytes=CONTAINER_BYTES)):
            ids, offsets = encoder.batch(batch.column("text"))
            closed = np.insert(ids, offsets[1:], end_id)
            lengths = np.diff(offsets) + 1
            keys = pc.fill_null(batch.column("k"), NULL_KEY).to_numpy()
            yield pa.RecordBatch.from_pydict({
                "container": pa.array([part * CHUNKS + chunk], pa.int64()), "part": pa.array([part], pa.int32()),
                "n_docs": pa.array([keys.size], pa.int64()), "n_tokens": pa.array([closed.size], pa.int64()),
                "keys": [keys.astype("<i8").tobytes()], "lengths": [lengths.astype("<u4").tobytes()],
                "payload": [closed.astype("<u2" if narrow else "<u4").tobytes()],
            })

    ordered = docs.select(F.coalesce("doc_id", F.lit(NULL_KEY).cast("long")).alias("k"), "text")
    ordered = ordered.repartitionByRange("k", F.xxhash64("text")).sortWithinPartitions("k", F.xxhash64("text"))
    # each container is a row group, so that one can be read alone
    groups = {"parquet.block.size": 1024, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1}
    ordered.mapInArrow(run, CONTAINERS).write.option("compression", "zstd").options(**groups).parquet(path)


def container_starts(containers: DataFrame) -> DataFrame:
    """(container, first_ordinal, first_token): sums before each container, by partition and then within it."""
    small = containers.select("container", "part", "n_docs", "n_tokens")
    parts = small.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition written
    parts = parts.select("part", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    inside = Window.partitionBy("part").orderBy("container").rowsBetween(Window.unboundedPreceding, -1)
    small = small.withColumn("d", F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("t", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return small.join(parts, "part").select("container", (F.col("d0") + F.col("d")).alias("first_ordinal"), (F.col("t0") + F.col("t")).alias("first_token"))


def _payload(payload: pa.Scalar, lengths: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a container, and the place of each of its documents in them."""
    n = np.frombuffer(lengths.as_buffer(), "<u4").astype(np.int64)
    at = np.append(0, np.cumsum(n))
    width = payload.as_buffer().size // max(1, int(at[-1]))
    return np.frombuffer(payload.as_buffer(), f"<u{width}" if n.size else "<u4"), at


def read_rows(containers: DataFrame) -> DataFrame:
    """(k, container, slot, at, n_tokens, ids_crc32) of every row of the payloads; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for container, keys, lengths, payload in zip(*(batch.column(c) for c in ("container", "keys", "lengths", "payload"))):
                ids, at = _payload(payload, lengths)
                ids = ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
                k = np.frombuffer(keys.as_buffer(), "<i8")
                yield pa.RecordBatch.from_pydict({
                    "k": pa.array(k), "container": pa.array(np.full(k.size, container.as_py()), pa.int64()), "slot": pa.array(np.arange(k.size), pa.int64()),
                    "at": pa.array(at[:-1], pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                })

    return containers.select("container", "keys", "lengths", "payload").mapInArrow(run, "k long, container long, slot long, at long, n_tokens long, ids_crc32 long")


# --- the minimal perfect hash


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Bits of all levels, one after another, and the sizes of the levels, for distinct int64 keys."""
    bits, sizes = [], []
    while keys.size:
        size = 2 * keys.size + 1
        spot = (_level_hash(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(spot, minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        keys = keys[~alone[spot]]
    return np.concatenate(bits) if bits else np.empty(0, bool), sizes


def mph_slots(bits: np.ndarray, sizes: list[int], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, or -1 where no level has it."""
    rank = np.cumsum(bits) - 1
    slot, open_, base = np.full(keys.size, -1, np.int64), np.arange(keys.size), 0
    for level, size in enumerate(sizes):
        spot = (_level_hash(keys[open_], level) % np.uint64(size)).astype(np.int64) + base
        hit = bits[spot]
        slot[open_[hit]] = rank[spot[hit]]
        open_ = open_[~hit]
        base += size
    return slot


def key_prints(keys: np.ndarray) -> np.ndarray:
    return (_level_hash(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def _bucket(column, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets))


def write_index(spark: SparkSession, path: str, index_path: str) -> int:
    """Build the index of the containers at path; returns its number of buckets."""
    containers = spark.read.parquet(path)
    n = containers.agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_KEYS))

    def keys_of(batches):
        for batch in batches:
            for first, container, keys, lengths in zip(batch.column("first_ordinal").to_pylist(), batch.column("container").to_pylist(), batch.column("keys"), batch.column("lengths")):
                k, n = np.frombuffer(keys.as_buffer(), "<i8"), np.frombuffer(lengths.as_buffer(), "<u4").astype(np.int64)
                offset = np.cumsum(n) - n
                yield pa.RecordBatch.from_pydict({"k": pa.array(k), "ordinal": pa.array(first + np.arange(k.size), pa.int64()), "container": pa.array(np.full(k.size, container)), "offset": pa.array(offset), "length": pa.array(n)})

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["k"].to_numpy(np.int64)
        bits, sizes = build_mph(keys)
        at = np.argsort(mph_slots(bits, sizes, keys))
        places = pdf[list(PLACE)].to_numpy(np.int64)[at].astype("<i8")
        row = (pdf["bucket"].iloc[0], keys.size, np.packbits(bits).tobytes(), np.array(sizes, "<i8").tobytes(), key_prints(keys)[at].tobytes(), places.tobytes())
        return pd.DataFrame([row], columns=["bucket", "n_keys", "level_bits", "levels", "prints", "places"])

    placed = containers.select("container", "keys", "lengths").join(container_starts(containers), "container")
    keys = placed.mapInArrow(keys_of, "k long, ordinal long, container long, offset long, length long").groupBy("k")
    keys = keys.agg(F.min(F.struct("ordinal", "container", "offset", "length")).alias("x"), F.count(F.lit(1)).alias("n")).select("k", "x.*", "n")
    keys.withColumn("bucket", _bucket(F.col("k"), buckets)).groupBy("bucket").applyInPandas(index, INDEX).write.parquet(index_path)
    return buckets


def find_keys(keys: np.ndarray, entry) -> tuple[np.ndarray, np.ndarray]:
    """Those of int64 keys that one bucket's entry of the index has, and their places (a row of PLACE each)."""
    sizes = np.frombuffer(entry["levels"], "<i8").tolist()
    bits = np.unpackbits(np.frombuffer(entry["level_bits"], np.uint8), count=sum(sizes)).astype(bool)
    slot = mph_slots(bits, sizes, keys)
    known = (slot >= 0) & (np.frombuffer(entry["prints"], "<u4")[np.maximum(slot, 0)] == key_prints(keys))
    return keys[known], np.frombuffer(entry["places"], "<i8").reshape(-1, len(PLACE))[slot[known]]


def lookup(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """(k, ordinal, container, offset, length, n) of the keys (column k) that the index has; keys are dealt to buckets of bounded size."""

    def find(_, own: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        keys, places = own["k"].to_numpy(np.int64), np.empty((0, len(PLACE)), np.int64)
        keys, places = find_keys(keys, entry.iloc[0]) if len(entry) and keys.size else (keys[:0], places)
        return pd.DataFrame({"k": keys, **{c: places[:, j] for j, c in enumerate(PLACE)}})

    own = keys.select("k").distinct().withColumn("bucket", _bucket(F.col("k"), buckets))
    return own.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, "k long, ordinal long, container long, offset long, length long, n long")


def verified(found: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (k, ordinal, ..., of `read_rows`) that found (of `lookup`) points to: of the same key, within the places of its rows."""
    places = found.select("k", F.col("ordinal").alias("first"), "n")
    return rows.join(places, "k").where((F.col("ordinal") >= F.col("first")) & (F.col("ordinal") < F.col("first") + F.col("n"))).drop("first", "n")


def fetch(spark: SparkSession, path: str, index_path: str, buckets: int, keys: list[int | None]) -> dict[int | None, np.ndarray]:
    """The ids of the first row of each key that is there; for as many keys as the driver can hold ids of.

    Reads the index entries of the keys' buckets and the containers they point to, by filters that Parquet applies."""
    wanted = spark.createDataFrame([(NULL_KEY if k is None else k,) for k in dict.fromkeys(keys)], "k long").withColumn("bucket", _bucket(F.col("k"), buckets))
    asked: dict[int, list[int]] = {}
    for r in wanted.collect():  # as many as keys
        asked.setdefault(r.bucket, []).append(r.k)
    places = {}
    for entry in spark.read.parquet(index_path).where(F.col("bucket").isin(list(asked))).toLocalIterator():
        found, at = find_keys(np.array(asked[entry["bucket"]], np.int64), entry)
        places.update(zip(found.tolist(), at.tolist()))
    by_container: dict[int, list[tuple[int, list[int]]]] = {}
    for k, place in places.items():
        by_container.setdefault(place[PLACE.index("container")], []).append((k, place))
    out = {}
    for row in containers_of(spark, path, list(by_container)).toLocalIterator():
        stored, n = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        ids = np.frombuffer(row["payload"], f"<u{len(row['payload']) // int(n.sum())}")
        begins = np.cumsum(n) - n
        for k, place in by_container[row["container"]]:
            offset, length = place[PLACE.index("offset")], place[PLACE.index("length")]
            if stored[np.searchsorted(begins, offset)] == k:  # else a fingerprint agreed by accident
                out[None if k == NULL_KEY else k] = ids[offset : offset + length].astype(np.uint32)
    return out


def containers_of(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """The containers of these numbers; row groups of others are not read."""
    return spark.read.parquet(path).where(F.col("container").isin(numbers)).select("container", "keys", "lengths", "payload")


def tokenizer_spec(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, index_path = shared_path(spark, "tokens"), shared_path(spark, "token-index")
    write_tokens(docs, tokenizer_spec(), path)
    buckets = write_index(spark, path, index_path)
    containers = spark.read.parquet(path)
    found = lookup(docs.select(F.coalesce("doc_id", F.lit(NULL_KEY).cast("long")).alias("k")), spark.read.parquet(index_path), buckets)
    rows = read_rows(containers).join(container_starts(containers), "container")
    rows = rows.select("k", (F.col("first_ordinal") + F.col("slot")).alias("ordinal"), (F.col("first_token") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    return verified(found, rows).select(F.when(F.col("k") != NULL_KEY, F.col("k")).alias("doc_id"), "start", "n_tokens", "ids_crc32")
