"""SentencePiece byte-fallback BPE by vectorised merge rounds.

A text is cut between two characters that stand side by side in no piece of the model: no merge can reach over such a
place, so segments are encoded alone, and each distinct segment once per batch. All distinct segments lie in one flat numpy symbol array. A round finds every segment's best pair
rank, merges its leftmost occurrences at once and compacts the array; segments without a pair left leave it.
Where a merge could open a pair of equal or better rank, only the leftmost occurrence is merged, which keeps the
rounds equal to the library's priority queue.

Edge cases: null and empty texts give no ids and decode to ''; texts of any length are encoded whole; repeated rows
are encoded alike; extra columns are ignored by `encode_documents`, which only reads doc_id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from vecspark.llm.common import distinct_spans, ragged, slices, table

SPACE = "▁"


@dataclass
class Tables:
    """Everything a worker needs, from the model file: a few MB, whatever the corpus."""

    surfaces: list[str]  # by symbol: pieces, then characters that only occur inside pieces
    n_pieces: int
    chars: dict[str, int]
    joined: np.ndarray  # pairs of neighbouring characters of pieces, as places in the sorted characters, from 1
    slots: np.ndarray  # open addressing: left * len(surfaces) + right, or -1
    slot_ids: np.ndarray
    probes: int
    rank: np.ndarray
    careful: np.ndarray  # pieces of which only the leftmost occurrence may merge in a round
    byte_ids: np.ndarray
    decimals: np.ndarray  # bytes of each id as a decimal with a comma
    decimal_at: np.ndarray
    raw: np.ndarray  # bytes that each id decodes to
    raw_at: np.ndarray

    def pair_ids(self, keys: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        slot = slot_of(keys, self.slots.size)
        found = self.slots[slot]
        out = np.where(found == keys, self.slot_ids[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.probes):
            if not open_.size:
                break
            slot_open = (slot[open_] + 1) & (self.slots.size - 1)
            slot[open_] = slot_open
            found = self.slots[slot_open]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_ids[slot_open[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out


def slot_of(keys: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def load_tables(model_bytes: bytes) -> Tables:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model_bytes)
    spec, norm = proto.trainer_spec, proto.normalizer_spec
    if spec.model_type != 2 or not spec.byte_fallback or spec.treat_whitespace_as_suffix:
        raise ValueError("a BPE model with byte fallback and leading word boundaries is needed")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("an identity normaliser with dummy prefix is needed")
    normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
    if any(SPACE in p.lstrip(SPACE) for p in normal):
        raise ValueError("a piece reaches over a word boundary")
    byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(proto.pieces) if p.type == 6}
    byte_ids = np.zeros(256, np.int64)
    for i, b in byte_of.items():
        byte_ids[b] = i
    surfaces = [p.piece for p in proto.pieces]
    symbol = dict(normal)
    for piece in normal:
        for c in piece:
            if c not in symbol:
                symbol[c] = len(surfaces)
                surfaces.append(c)
    order = {s: r for r, s in enumerate(sorted({proto.pieces[i].score for i in normal.values()}, reverse=True))}
    rank = np.full(len(surfaces), 1 << 30, np.int64)
    for i in normal.values():
        rank[i] = order[proto.pieces[i].score]
    careful = np.zeros(len(surfaces), bool)
    keys, ids = [], []
    for piece, i in normal.items():
        for k in range(1, len(piece)):
            a, b = symbol.get(piece[:k]), symbol.get(piece[k:])
            if a is not None and b is not None:
                keys.append(a * len(surfaces) + b)
                ids.append(i)
            for part in (a, b):
                if part is not None and rank[i] <= rank[part] < 1 << 30:
                    careful[part] = True
    chars = {s: i for s, i in symbol.items() if len(s) == 1}
    place = {c: k for k, c in enumerate(sorted(chars), 1)}
    joined = np.array(sorted({(place[a], place[b]) for p in normal for a, b in zip(p, p[1:])}), np.int64)
    size = 1 << (4 * len(keys)).bit_length()
    slots, slot_ids, probes = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0
    for key, slot, i in zip(keys, slot_of(np.array(keys, np.int64), size).tolist(), ids):
        n = 0
        while slots[slot] >= 0:
            slot, n = (slot + 1) & (size - 1), n + 1
        slots[slot], slot_ids[slot], probes = key, i, max(probes, n)
    decimals = [f"{i},".encode() for i in range(len(proto.pieces))]
    raw = [bytes([byte_of[i]]) if i in byte_of else b"" if p.type == 3 else p.piece.replace(SPACE, " ").encode() for i, p in enumerate(proto.pieces)]
    flat = lambda x: (np.frombuffer(b"".join(x), np.uint8), np.append(0, np.cumsum([len(y) for y in x])))
    return Tables(surfaces, len(proto.pieces), chars, joined, slots, slot_ids, probes, rank, careful, byte_ids, *flat(decimals), *flat(raw))


def merge_rounds(t: Tables, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the flat symbols of words 0, 1, ... (word: the ascending word of each symbol) until no pair is left."""
    done_s, done_w = [], []
    n = len(t.surfaces)
    none = np.int64(1) << 40
    while symbols.size:
        same = (word[:-1] == word[1:]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)
        made = np.append(np.where(same, t.pair_ids(np.where(same, symbols[:-1] * n + symbols[1:], 0)), -1), -1)
        merged = np.maximum(made, 0)
        rank = np.where(made >= 0, t.rank[merged], none)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(first, word.size))
        best = np.minimum.reduceat(rank, first)
        active = np.repeat(best < none, size)
        if not active.all():
            done_s.append(symbols[~active])
            done_w.append(word[~active])
            symbols, word, merged, rank = symbols[active], word[active], merged[active], rank[active]
            size, best = size[best < none], best[best < none]
            if not symbols.size:
                break
            first = np.append(0, np.cumsum(size)[:-1])
        spot = rank == np.repeat(best, size)
        position = np.flatnonzero(spot)
        # leftmost of each word, and whether its word may only merge that one
        w = np.repeat(np.arange(first.size), size)[position]
        lead = np.append(True, w[1:] != w[:-1])
        piece = merged[position]
        lead_at = np.flatnonzero(lead)
        count = np.diff(np.append(lead_at, position.size))
        only = t.careful[piece]
        mixed = piece != np.repeat(piece[lead_at], count)
        single = np.logical_or.reduceat(only | mixed, lead_at)
        keep = lead | ~np.repeat(single, count)
        # of overlapping occurrences every second goes: runs of neighbouring positions keep even members
        run_start = np.append(True, (np.diff(position) != 1) | (w[1:] != w[:-1]))
        start_at = np.flatnonzero(run_start)
        in_run = np.arange(position.size) - np.repeat(start_at, np.diff(np.append(start_at, position.size)))
        keep &= in_run % 2 == 0
        position, piece = position[keep], piece[keep]
        symbols[position] = piece
        stay = np.ones(symbols.size, bool)
        stay[position + 1] = False
        symbols, word = symbols[stay], word[stay]
    if not done_s:
        return symbols, word
    symbols, word = np.concatenate(done_s), np.concatenate(done_w)
    at = np.argsort(word, kind="stable")
    return symbols[at], word[at]


def encode_symbols(t: Tables, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of words 0 to n - 1 and their offsets; a symbol below 0 is a character that no piece has."""
    symbols, word = merge_rounds(t, symbols, word)
    # characters that are no piece become bytes
    loose = (symbols < 0) | (symbols >= t.n_pieces)
    if loose.any():
        spelled = {s: t.byte_ids[list((chr(-1 - s) if s < 0 else t.surfaces[s]).encode())] for s in np.unique(symbols[loose]).tolist()}
        reps = np.ones(symbols.size, np.int64)
        where = np.flatnonzero(loose)
        reps[where] = [spelled[s].size for s in symbols[where].tolist()]
        start = np.cumsum(reps) - reps
        out = np.repeat(symbols, reps)
        for i in where.tolist():
            out[start[i] : start[i] + reps[i]] = spelled[int(symbols[i])]
        symbols, word = out, np.repeat(word, reps)
    return symbols, np.searchsorted(word, np.arange(n + 1))


def decode_ids(t: Tables, ids: list[int]) -> str:
    """The library's decode(ids): pieces joined, byte runs read as UTF-8, boundaries as spaces, without the first one."""
    size = np.diff(t.raw_at)[ids]
    text = t.raw[ragged(t.raw_at[ids], size)].tobytes().decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


class Encoder:
    """Encodes batches of texts, each distinct segment of a batch once."""

    def __init__(self, tables: Tables):
        self.t = tables
        chars = sorted(tables.chars.items())
        self.char_class = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.symbol = np.zeros(len(chars) + 1, np.int64)
        for k, (c, i) in enumerate(chars, 1):
            self.char_class[ord(c)] = k
            self.symbol[k] = i
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.joins[tables.joined[:, 0], tables.joined[:, 1]] = True

    def batch(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(n_tokens, ids as decimals joined by commas, decoded text) of each text."""
        texts = [SPACE + x if x else "" for x in texts]
        sizes = np.array([len(x) for x in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        points = np.where(points == 0x20, np.uint32(ord(SPACE)), points)
        starts_of = np.append(0, np.cumsum(sizes))
        if not points.size:
            yield from ((0, b"", b"") for _ in texts)
            return
        kind = self.char_class[points]
        begins = np.append(True, ~self.joins[kind[:-1], kind[1:]])
        begins[starts_of[:-1][sizes > 0]] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, points.size))
        rep, inverse = distinct_spans(points, starts, lengths)
        at = ragged(starts[rep], lengths[rep])
        known = np.where(kind[at] > 0, self.symbol[kind[at]], -1 - points[at].astype(np.int64))
        ids, offsets = encode_symbols(self.t, known, np.repeat(np.arange(rep.size), lengths[rep]), rep.size)
        n_ids = np.diff(offsets)[inverse]
        first = np.searchsorted(starts, starts_of)
        total = np.append(0, np.cumsum(n_ids))[first]
        decimals, decimal_at = self._spread(self.t.decimals, self.t.decimal_at, ids, offsets, inverse, first)
        surfaces, surface_at = self._spread(self.t.raw, self.t.raw_at, ids, offsets, inverse, first)
        for k in range(len(texts)):
            text = surfaces[surface_at[k] : surface_at[k + 1]]
            yield int(total[k + 1] - total[k]), decimals[decimal_at[k] : max(decimal_at[k], decimal_at[k + 1] - 1)], text[1:] if text[:1] == b" " else text

    @staticmethod
    def _spread(data, data_at, ids, offsets, inverse, first) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts, put together from those of their ids, and the place of each text in them."""
        size = np.diff(data_at)[ids]
        of_segment = data[ragged(data_at[ids], size)]
        bounds = np.append(0, np.cumsum(size))[offsets]
        lengths = np.diff(bounds)[inverse]
        return of_segment[ragged(bounds[:-1][inverse], lengths)].tobytes(), np.append(0, np.cumsum(lengths))[first]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, model_bytes: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs (doc_id, text); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(load_tables(model_bytes))

    def run(batches):
        encoder = Encoder(shared.value)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for part in slices(batches, "text", max_bytes=1 << 20):
            rows = [(n, sha(ids), sha(text)) for n, ids, text in encoder.batch(pc.fill_null(part.column("text"), "").to_pylist())]
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_bytes())
