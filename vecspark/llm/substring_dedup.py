"""Removal of repeated passages by suffix automata of reference passages.

A window is WINDOW consecutive words of one document. Every word covered by a window that also starts earlier (smaller
doc_id, or same document and earlier start) goes.

Documents are dealt by a hash of doc_id to batches of about BATCH_BYTES of text. Two rounds of questions find where to look:
 1. every batch asks which of its anchors (the least hash of ANCHOR words in each window) other batches have as well;
 2. of windows with such anchors it asks for the smallest doc_id that has the window: its owner.
Questions are sets of hashes, distinct within a batch, so a passage that a third of all documents share costs one entry
a batch. Owners then hand out the reference passages that others need, by a join that can be split where many batches
need one owner. Each batch builds a suffix automaton of the
reference passages it needs, streams its documents' candidate runs through it, and takes from the matching statistics
the maximal spans of at least WINDOW words whose first place in the references is earlier. The automaton compares words,
not hashes, so an accidental equality of hashes removes nothing.

The references of a whole corpus grow with it, so their automata are not broadcast whole: each batch gets the shard
it needs. All rounds are one query over one exchange of the texts.

Edge cases: null and empty texts have no words and are kept as they are; a document shorter than a window loses
nothing; texts are read whole, of any length (a longer text than a batch makes a larger batch); windows may repeat and
overlap within one document; rows that repeat a doc_id are ordered by their texts and count as one after the other, and
are in one batch; rows without doc_id come before all others, in order of a hash of their texts, and are dealt by it
(doc_ids below -2 ** 62 fall among them); an empty table gives an empty result; other columns pass through `remove_repeats` (names that start with _sub_ are reserved).
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import distinct_spans, mix64, ragged, span_hashes, table, text_bytes, words_of
from vecspark.llm.suffix_automaton import SuffixAutomaton

WINDOW, ANCHOR = 20, 12
BATCH_BYTES = 900_000
BUCKET_ENTRIES = 196_608
NULL_KEY = -(2**63)
ASKED = "_sub_r int, _sub_b long, _sub_keys binary, _sub_docs binary"
ANSWER = "_sub_b long, _sub_kind int, _sub_r int, _sub_bits binary, _sub_owners binary, _sub_index binary, _sub_text binary"
LINE = "_sub_o long, _sub_to long, _sub_starts binary, _sub_text binary"


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


class Batch:
    """The words, anchors and windows of the documents of one batch, in order of (doc_id, text)."""

    def __init__(self, docs: pa.Table):
        self.docs = docs.take(pc.sort_indices(docs, [("_sub_k", "ascending"), ("text", "ascending")]))
        self.keys = _column(self.docs, "_sub_k").to_numpy(zero_copy_only=False)
        self.raw, offsets = text_bytes(_column(self.docs, "text"))
        self.starts, self.lengths, self.first = words_of(self.raw, offsets)
        n = self.starts.size
        self.doc = np.repeat(np.arange(self.keys.size), np.diff(self.first))
        self.word = span_hashes(self.raw, self.starts, self.lengths) if n else np.empty(0, np.uint64)
        m = max(0, n - WINDOW + 1)
        self.at = np.flatnonzero(self.doc[:m] == self.doc[WINDOW - 1 : WINDOW - 1 + m])  # starts of windows

    @cached_property
    def anchor(self) -> np.ndarray:
        """The least hash of ANCHOR words in each window, mixed again so that anchors spread evenly over the buckets."""
        if not self.at.size:
            return np.empty(0, np.uint64)
        grams = self.word.size - ANCHOR + 1
        low = span_hashes(self.word, np.arange(grams), np.full(grams, ANCHOR))
        span, width = WINDOW - ANCHOR + 1, 1
        while 2 * width <= span:  # least of ever wider spans
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        return mix64(np.minimum(low[: low.size - (span - width)], low[span - width :])[self.at])

    @cached_property
    def _windows(self) -> tuple[np.ndarray, ...]:
        hashes = span_hashes(self.word, self.at, np.full(self.at.size, WINDOW)) if self.at.size else np.empty(0, np.uint64)
        return np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)

    # distinct windows in ascending order of their hashes, with their first places here
    unique = property(lambda self: self._windows[0])
    first_at = property(lambda self: self._windows[1])
    inverse = property(lambda self: self._windows[2])
    count = property(lambda self: self._windows[3])

    def anchors(self) -> np.ndarray:
        return np.unique(self.anchor)

    def candidates(self, answers: pa.Table, buckets: int) -> np.ndarray:
        """Numbers of the distinct windows whose anchors other batches have."""
        own = self.anchors()
        common = own[_bits(answers, 1, own, buckets)]
        return np.flatnonzero(np.isin(self.anchor[self.first_at], common)) if common.size else np.empty(0, np.int64)

    def owners(self, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The smallest doc_id that has each distinct window, and whether other batches have it."""
        owner = self.keys[self.doc[self.at[self.first_at]]] if self.at.size else np.empty(0, np.int64)
        shared = np.zeros(owner.size, bool)
        numbers = self.candidates(answers, buckets)
        hit = _bits(answers, 2, self.unique[numbers], buckets)
        shared[numbers[hit]] = True
        rows = {r["_sub_r"]: r for r in _rows(answers, 2)}
        found = [np.frombuffer(rows[r]["_sub_owners"], "<i8")[np.frombuffer(rows[r]["_sub_index"], "<u4")] for r in sorted(rows)]
        if found:
            owner = owner.copy()
            owner[shared] = np.concatenate(found)
        return owner, shared

    def runs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of the maximal runs of chosen windows (a mask over windows)."""
        spot = self.at[chosen]
        if not spot.size:
            return spot, spot
        new = np.append(True, np.diff(spot) != 1)
        begin = spot[new]
        return begin, np.append(spot[np.flatnonzero(new)[1:] - 1], spot[-1]) - begin + WINDOW

    def words(self, begin: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words of runs, each with a space after it, and the number of bytes before each run."""
        word = ragged(begin, size)
        raw = np.append(self.raw, np.uint8(32))
        out = raw[ragged(self.starts[word], self.lengths[word] + 1)]
        ends = np.cumsum(self.lengths[word] + 1)
        out[ends - 1] = 32
        return out.tobytes(), np.append(0, ends)[np.append(0, np.cumsum(size))]


def _rows(t: pa.Table, kind: int) -> list[dict]:
    return t.filter(pc.equal(t.column("_sub_kind"), kind)).to_pylist() if t.num_rows else []


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; it grows with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _bits(answers: pa.Table, kind: int, asked: np.ndarray, buckets: int) -> np.ndarray:
    """The answers' bits for the sorted hashes that were asked."""
    out = np.zeros(asked.size, bool)
    bucket = _bucket(asked, buckets)
    for row in _rows(answers, kind):
        a, b = np.searchsorted(bucket, [row["_sub_r"], row["_sub_r"] + 1]).tolist()
        out[a:b] = np.unpackbits(np.frombuffer(row["_sub_bits"], np.uint8), count=b - a)
    return out


def _questions(b: int, hashes: np.ndarray, docs: np.ndarray | None, buckets: int) -> pa.Table:
    used, begin = np.unique(_bucket(hashes, buckets), return_index=True)  # of the sorted hashes only buckets in use
    spans = list(zip(begin.tolist(), [*begin[1:].tolist(), hashes.size]))
    return pa.table({
        "_sub_r": pa.array(used, pa.int32()), "_sub_b": pa.array([b] * used.size, pa.int64()),
        "_sub_keys": pa.array([hashes[x:y].tobytes() for x, y in spans], pa.binary()),
        "_sub_docs": pa.array([b"" if docs is None else docs[x:y].tobytes() for x, y in spans], pa.binary()),
    })


def _answers(rows: list[tuple]) -> pa.Table:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = ("_sub_b", "_sub_kind", "_sub_r", "_sub_bits", "_sub_owners", "_sub_index", "_sub_text")
    columns = list(zip(*rows)) or [()] * 7
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})


def _respond(kind: int):
    """Answers one bucket of hashes: whether other batches ask for each, and (kind 2) its smallest doc_id."""

    def run(key, t):
        batches, keys = t.column("_sub_b").to_pylist(), [np.frombuffer(x, "<u8") for x in t.column("_sub_keys").to_pylist()]
        sizes = [k.size for k in keys]
        flat = np.concatenate(keys)
        _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        shared = counts[inverse] > 1
        owner = None
        if kind == 2:
            docs = np.concatenate([np.frombuffer(x, "<i8") for x in t.column("_sub_docs").to_pylist()])
            least = np.full(counts.size, np.iinfo(np.int64).max)
            np.minimum.at(least, inverse, docs)
            owner = least[inverse]
        out, at = [], 0
        for b, n in zip(batches, sizes):
            bits = shared[at : at + n]
            if bits.any():
                names, index = np.unique(owner[at : at + n][bits], return_inverse=True) if kind == 2 else (np.empty(0, "<i8"), np.empty(0))
                out.append((b, kind, key[0].as_py(), np.packbits(bits).tobytes(), names.astype("<i8").tobytes(), index.astype("<u4").tobytes(), b""))
            at += n
        return _answers(out)

    return run


def _references(batch: Batch, answers: pa.Table, buckets: int, b: int) -> pa.Table:
    """The passages that other batches need of this one's documents, and what it needs of theirs."""
    owner, shared = batch.owners(answers, buckets)
    first_doc = batch.doc[batch.at[batch.first_at]] if batch.at.size else np.empty(0, np.int64)
    ours = shared & (owner == batch.keys[first_doc]) if owner.size else shared
    lines: list[tuple] = []
    chosen = np.zeros(batch.at.size, bool)
    chosen[batch.first_at[ours]] = True
    begin, size = batch.runs(chosen)
    if begin.size:
        text, at = batch.words(begin, size)
        docs = batch.doc[begin]
        # rows that repeat a doc_id hand out their passages together, their places counted from the first row
        for k in np.unique(batch.keys[docs]).tolist():
            mine = np.flatnonzero(batch.keys[docs] == k)
            base = batch.first[np.searchsorted(batch.keys, k)]
            packed = np.column_stack([begin[mine] - base, size[mine]]).astype("<i8").tobytes()
            joined = text[at[mine[0]] : at[mine[-1] + 1]]
            lines.append((k, None, packed, joined))
    need = np.unique(owner[shared & ~ours]) if owner.size else np.empty(0, np.int64)
    lines += [(o, b, b"", b"") for o in need.tolist()]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    columns = list(zip(*lines)) or [()] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("_sub_o", "_sub_to", "_sub_starts", "_sub_text"), columns, types)})


def removed_words(batch: Batch, answers: pa.Table, buckets: int) -> np.ndarray:
    """A mask over the batch's words: covered by a window that starts earlier somewhere."""
    gone = np.zeros(batch.starts.size + 1, np.int64)
    owner, shared = batch.owners(answers, buckets)
    if not owner.size:
        return gone[:-1] > 0
    first_doc = batch.doc[batch.at[batch.first_at]]
    ours = owner == batch.keys[first_doc]
    # candidate windows: not the first of their kind
    is_first = np.zeros(batch.at.size, bool)
    is_first[batch.first_at[ours]] = True
    repeated = (shared | (batch.count > 1))[batch.inverse]
    begin, size = batch.runs(repeated & ~is_first)
    if not begin.size:
        return gone[:-1] > 0
    # references in order of (doc_id, place): passages handed out by others, and our own windows that repeat here
    own_chosen = np.zeros(batch.at.size, bool)
    own_chosen[batch.first_at[ours & (batch.count > 1)]] = True
    own_begin, own_size = batch.runs(own_chosen)
    base = batch.first[np.searchsorted(batch.keys, batch.keys[batch.doc[own_begin]])] if own_begin.size else own_begin
    refs = [(k, a, n, None, s) for k, a, n, s in zip(batch.keys[batch.doc[own_begin]].tolist(), (own_begin - base).tolist(), own_size.tolist(), own_begin.tolist())]
    far, far_at = [], 0
    for row in _rows(answers, 3):
        k = int.from_bytes(row["_sub_owners"], "big", signed=True)
        for a, n in np.frombuffer(row["_sub_index"], "<i8").reshape(-1, 2).tolist():
            refs.append((k, a, n, far_at, None))
            far_at += n
        far.append(row["_sub_text"])
    refs.sort(key=lambda r: (r[0], r[1]))
    # one numbering of the words of references and candidates, by their bytes
    extra = np.frombuffer(b"".join(far), np.uint8)
    far_start, far_length, _ = words_of(extra, np.array([0, extra.size]))
    mine = np.unique(np.concatenate([ragged(begin, size), ragged(own_begin, own_size)]))
    raw = np.concatenate([batch.raw, extra])
    _, number = distinct_spans(raw, np.concatenate([batch.starts[mine], far_start + batch.raw.size]), np.concatenate([batch.lengths[mine], far_length]))
    number_of = np.zeros(batch.starts.size, np.int64)
    number_of[mine] = number[: mine.size]
    far_number = number[mine.size :].tolist()
    symbols: list[int] = []
    ref_at, ref_key, ref_start = [], [], []
    for r, (k, a, n, f, s) in enumerate(refs):
        ref_at.append(len(symbols))
        ref_key.append(k)
        ref_start.append(a)
        symbols += far_number[f : f + n] if s is None else number_of[s : s + n].tolist()
        symbols.append(-1 - r)  # nothing matches across passages
    automaton = SuffixAutomaton(symbols)
    ref_at, ref_key, ref_start = np.array(ref_at, np.int64), np.array(ref_key, np.int64), np.array(ref_start, np.int64)
    for a, n in zip(begin.tolist(), size.tolist()):
        ends = np.array(automaton.first_matches(number_of[a : a + n].tolist(), WINDOW), np.int64)
        i = np.flatnonzero(ends >= 0)
        place = ends[i] - WINDOW + 1
        ref = np.searchsorted(ref_at, place, "right") - 1
        key, start = ref_key[ref], ref_start[ref] + place - ref_at[ref]
        own_start = a + i - WINDOW + 1
        own_key = batch.keys[batch.doc[a]]
        own_base = batch.first[np.searchsorted(batch.keys, own_key)]
        earlier = (key < own_key) | (key == own_key) & (start < own_start - own_base)
        np.add.at(gone, own_start[earlier], 1)
        np.add.at(gone, own_start[earlier] + WINDOW, -1)
    return np.cumsum(gone[:-1]) > 0


def _dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with _sub_k, which orders documents, and _sub_b, their batch; and the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    unnamed = F.lit(NULL_KEY).cast("long") + F.shiftrightunsigned(F.xxhash64("text"), 2)
    docs = docs.withColumn("_sub_k", F.coalesce(F.col("doc_id").cast("long"), unnamed))
    return docs.withColumn("_sub_b", F.pmod(F.xxhash64("_sub_k"), F.lit(max(1, -(-size // BATCH_BYTES))))), size


def _find(docs: DataFrame, size: int, emit, schema) -> DataFrame:
    """Run the rounds over docs (with _sub_k, _sub_b and text; size: bytes of all texts) and give emit(batch, removed mask) of each batch."""
    buckets = max(1, -(-size // 32 // BUCKET_ENTRIES))  # some 30 bytes of text an anchor
    dealt = docs.groupBy("_sub_b")

    def ask(key, t):
        return _questions(key[0].as_py(), Batch(t).anchors(), None, buckets)

    common = dealt.applyInArrow(ask, ASKED).groupBy("_sub_r").applyInArrow(_respond(1), ANSWER)

    def ask_owners(key, t, answers):
        batch = Batch(t)
        chosen = batch.candidates(answers, buckets)
        docs = batch.keys[batch.doc[batch.at[batch.first_at[chosen]]]] if chosen.size else np.empty(0, np.int64)
        return _questions(key[0].as_py() if key[0].as_py() is not None else 0, batch.unique[chosen], docs.astype("<i8"), buckets)

    owners = dealt.cogroup(common.groupBy("_sub_b")).applyInArrow(ask_owners, ASKED).groupBy("_sub_r").applyInArrow(_respond(2), ANSWER)
    known = common.unionAll(owners)

    def references(key, t, answers):
        return _references(Batch(t), answers, buckets, key[0].as_py())

    lines = dealt.cogroup(known.groupBy("_sub_b")).applyInArrow(references, LINE)
    given = lines.where("_sub_to IS NULL").select("_sub_o", "_sub_starts", "_sub_text")
    handed = lines.where("_sub_to IS NOT NULL").select("_sub_o", F.col("_sub_to").alias("_sub_b")).join(given, "_sub_o")
    empty = F.lit(b"")
    handed = handed.select(
        "_sub_b", F.lit(3).alias("_sub_kind"), F.lit(0).alias("_sub_r"), empty.alias("_sub_bits"), F.unhex(F.lpad(F.hex("_sub_o"), 16, "0")).alias("_sub_owners"),
        F.col("_sub_starts").alias("_sub_index"), "_sub_text",
    )

    def finish(key, t, answers):
        batch = Batch(t)
        return emit(batch, removed_words(batch, answers, buckets))

    return dealt.cogroup(known.unionAll(handed).groupBy("_sub_b")).applyInArrow(finish, schema)


def _kept(batch: Batch, gone: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words, each with a space after it, and the place of each document in them."""
    word = np.flatnonzero(~gone)
    raw = np.append(batch.raw, np.uint8(32))
    size = batch.lengths[word] + 1
    out = raw[ragged(batch.starts[word], size)]
    ends = np.cumsum(size)
    out[ends - 1] = 32
    return out.tobytes(), np.append(0, ends)[np.searchsorted(word, batch.first)]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of docs (doc_id, text)."""

    def emit(batch: Batch, gone: np.ndarray) -> pa.Table:
        text, at = _kept(batch, gone)
        removed = np.append(0, np.cumsum(gone))[batch.first]
        sha = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist())]
        return pa.table({"doc_id": batch.docs.column("doc_id"), "n_words": pa.array(np.diff(batch.first), pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    dealt, size = _dealt(docs.select("doc_id", "text"))
    return _find(dealt, size, emit, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages taken out of text; texts that lose nothing stay as they are, the others' kept words
    are joined by single spaces. All columns and rows stay."""
    columns = docs.columns

    def emit(batch: Batch, gone: np.ndarray) -> pa.Table:
        text, at = _kept(batch, gone)
        lost = np.diff(np.append(0, np.cumsum(gone))[batch.first]) > 0
        old = _column(batch.docs, "text").to_pylist()
        new = [text[a : max(a, b - 1)].decode() if x else o for x, a, b, o in zip(lost.tolist(), at.tolist(), at[1:].tolist(), old)]
        return pa.table({c: pa.array(new, pa.string()) if c == "text" else batch.docs.column(c) for c in columns})

    dealt, size = _dealt(docs)
    return _find(dealt, size, emit, docs.schema)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


#: Rows without doc_id come first, as there; where several of those share a window, SQL orders them by text, not by its hash.
OP2_SQL = r"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT n, i, array_to_string(w[i : i + 19], ' ') AS x FROM d, unnest(range(1, len(w) - 18)) t(i)),
placed AS (SELECT n, i, row_number() OVER (PARTITION BY x ORDER BY n, i) > 1 AS again FROM windows),
gone AS (SELECT DISTINCT n, i + j AS p FROM placed, range(20) r(j) WHERE again),
words AS (SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT n, count(gone.p) AS removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS body FROM words LEFT JOIN gone USING (n, p) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (n)"""
