"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negator, reporter, other). Small transducers read the symbols of a clause
and weigh what happens: an insult emits its weight, more with a target near it; a threat emits when a target follows;
negation and reported speech scale the emissions down. Their composition is determinised into one table of states as
clauses are read, and clauses without an insult or a threat are never entered. A document is scored by its matched
clauses (their highest and summed weight, also per word) with a logistic curve.

The grammar is seeded with a short word list; insult words, and stems with open endings, are learned from labels:
words and prefixes that labelled toxic texts hold in many different contexts, and clean ones hardly ever. Contexts
are counted, not documents alone, so that copies of one text don't teach their other words.

Edge cases: a null or empty text has no clause and gets the lowest score, which is still defined; texts are read whole;
repeated rows score alike; with no usable label of a class the seeded grammar is used with fixed coefficients;
an empty table gives an empty result; extra columns are ignored, or kept by `score_documents` under any name that does
not start with _tox_, the prefix of all columns that the operator makes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vecspark.llm.common import cut, distinct_spans, slices, table, text_bytes, words_of
from vecspark.llm.labelled import fold, training_rows

PARTS, HELD = 4, 2
THRESHOLD = 0.3
TRAIN_PER_CLASS = 4_000  # bound of the labelled sample, for each class
STEM_LENGTHS = (3, 4, 5, 6, 7, 8, 9, 10)
MIN_GAIN = 14.0  # log-likelihood ratio that a learned word needs
MIN_CONTEXTS = 4
MEMO_WORDS = 150_000  # of a task; about 40 MB

OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORTER = range(6)

# Seed words of the grammar.
INSULTS = "idiot idiots moron morons stupid scum trash loser losers clown pathetic worthless disgusting dumb imbecile bastard filth vermin degenerate"
THREATS = "kill hurt destroy murder burn strangle shoot stab"
TARGETS = "you your you're u he she they him her them his their du dich dir ihr euch sie tu te toi vous tú usted ustedes vosotros"
NEGATORS = "not never don't isn't aren't wasn't nicht kein keine nie ne pas jamais nunca jamás"
REPORTERS = "said says called quoted quote quotes reported wrote claims claimed alleged sagte nannte schrieb dit écrit dijo escribió"


# --- transducers: step(state, symbol) -> (state, value); a composition multiplies factors and adds emissions


def insult_step(state: int, symbol: int) -> tuple[int, float]:
    """Emits on insults, a half more where a target stood up to three words before; state: words since the target."""
    if symbol == INSULT:
        return state, 1.5 if state else 1.0
    if symbol == TARGET:
        return 3, 0.0
    return max(0, state - 1), 0.0


def threat_step(state: int, symbol: int) -> tuple[int, float]:
    """Emits on a target up to three words after a threat; state: words left."""
    if symbol == THREAT:
        return 3, 0.0
    if symbol == TARGET and state:
        return 0, 1.0
    return max(0, state - 1), 0.0


def negation_step(state: int, symbol: int) -> tuple[int, float]:
    """A factor below one for three words after a negator."""
    if symbol == NEGATOR:
        return 3, 1.0
    return max(0, state - 1), 0.6 if state else 1.0


def report_step(state: int, symbol: int) -> tuple[int, float]:
    """A factor below one from a reporting verb to the end of the clause."""
    state = 1 if symbol == REPORTER else state
    return state, 0.7 if state else 1.0


class Grammar:
    """The composed machine, determinised as it is used: at most 4 * 4 * 4 * 2 states by 6 symbols."""

    def __init__(self):
        self.numbers = {(0, 0, 0, 0): 0}
        self.states = [(0, 0, 0, 0)]
        self.table: dict[int, tuple[int, float, float]] = {}

    def step(self, state: int, symbol: int) -> tuple[int, float, float]:
        """(next state, factor on an insult's own weight, emission of a threat)."""
        key = state * 6 + symbol
        if key not in self.table:
            i, t, n, r = self.states[state]
            (i, insult), (t, threat), (n, a), (r, b) = insult_step(i, symbol), threat_step(t, symbol), negation_step(n, symbol), report_step(r, symbol)
            if (i, t, n, r) not in self.numbers:
                self.numbers[(i, t, n, r)] = len(self.states)
                self.states.append((i, t, n, r))
            self.table[key] = (self.numbers[(i, t, n, r)], insult * a * b, threat * a * b)
        return self.table[key]

    def clause(self, symbols: list[int], weights: list[float]) -> float:
        state, total = 0, 0.0
        for symbol, weight in zip(symbols, weights):
            state, insult, threat = self.step(state, symbol)
            total += insult * weight + 2.0 * threat
        return total


@dataclass
class Lexicon:
    """Words and open stems with their insult weights; their number is bounded by the labelled sample."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


_CORES = re.compile(r"[^\W\d_]+")
_PIECES = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*[@$]?|[@$][^\W_]+(?:[@$][^\W_]+)*[@$]?")  # letters, digits and the marks that stand for letters
_SPELLED = str.maketrans("013457@$", "oieastas")


class Reader:
    """Reads batches of texts into clause features."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.grammar = lexicon, Grammar()
        self.fixed = {}
        for words, symbol in ((TARGETS, TARGET), (NEGATORS, NEGATOR), (REPORTERS, REPORTER), (THREATS, THREAT)):
            self.fixed.update(dict.fromkeys(words.split(), symbol))
        self.memo: dict[bytes, tuple[int, float]] = {}

    def symbol(self, word: bytes) -> tuple[int, float]:
        """Symbol and weight of a word; 8 is added to the symbol where the word closes its clause."""
        text = word.decode("utf-8", "replace").lower()
        stop = 8 * (text[-1] in ".!?;:,…")
        best = max((self.weight(core) for core in _CORES.findall(text)), default=0.0)
        if not best and not text.isalpha():  # spelled with digits or marks, piece by piece, or with marks between all letters
            best = max((self.weight("".join(_CORES.findall(p.translate(_SPELLED)))) for p in _PIECES.findall(text)), default=0.0)
            best = best or self.weight("".join(_CORES.findall(text.translate(_SPELLED))))
        if best:
            return stop + INSULT, best
        return stop + self.fixed.get(text.strip(".!?;:,…\"'()[]"), OTHER), 0.0

    def weight(self, core: str) -> float:
        own = self.lexicon.words.get(core, 0.0)
        for n in STEM_LENGTHS:
            if len(core) > n:
                own = max(own, self.lexicon.stems.get(core[:n], 0.0))
        return own

    def features(self, texts: pa.Array) -> np.ndarray:
        """(highest clause weight, summed clause weight, words) of each text."""
        raw, offsets = text_bytes(texts)
        starts, lengths, first = words_of(raw, offsets)
        out = np.zeros((len(offsets) - 1, 3))
        out[:, 2] = np.diff(first)
        if not starts.size:
            return out
        rep, inverse = distinct_spans(raw, starts, lengths)
        blob = raw.tobytes()
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        kinds, memo = [], self.memo
        for a, n in zip(starts[rep].tolist(), lengths[rep].tolist()):
            word = blob[a : a + n]
            kind = memo.get(word)
            if kind is None:
                kind = self.symbol(word)
                if n <= 64:  # longer ones hardly come again
                    memo[word] = kind
            kinds.append(kind)
        kind = np.array([k for k, _ in kinds], np.int8)[inverse]
        weight = np.array([w for _, w in kinds])[inverse]
        ends = starts + lengths
        closes = (kind >= 8) | ((ends < raw.size) & (raw[np.minimum(ends, raw.size - 1)] == 10))
        closes[first[1:][np.diff(first) > 0] - 1] = True
        kind &= 7
        clause = np.append(0, np.cumsum(closes)[:-1])
        matched = np.unique(clause[(kind == INSULT) | (kind == THREAT)])
        begin, end = np.searchsorted(clause, matched), np.searchsorted(clause, matched, "right")
        doc = np.searchsorted(first, begin, "right") - 1
        for d, a, b in zip(doc.tolist(), begin.tolist(), end.tolist()):
            score = self.grammar.clause(kind[a:b].tolist(), weight[a:b].tolist())
            out[d, 0] = max(out[d, 0], score)
            out[d, 1] += score
        return out


def design(features: np.ndarray) -> np.ndarray:
    top, total, words = features.T
    return np.column_stack([np.ones(len(top)), np.minimum(top, 4.0), np.log1p(total), np.log1p(1000.0 * total / np.maximum(words, 50.0))])


DEFAULT_CURVE = (-3.0, 2.0, 0.5, 0.2)


def fit_curve(features: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    if len(set(y.tolist())) < 2:
        return DEFAULT_CURVE
    x, beta = design(features), np.zeros(4)
    ridge = np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge @ beta
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge
        move = np.linalg.solve(h, g)
        beta -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return tuple(beta.tolist())


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Insult words and stems from rows (doc_id, text, y) of a bounded sample."""
    seed = {w: 1.0 for w in INSULTS.split()}
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")
    rows = train.select("doc_id", "y", words.alias("w")).select("doc_id", "y", "w", F.posexplode("w").alias("i", "word")).where(F.length("word") >= 4)
    context = F.xxhash64(F.get("w", F.col("i") - 1), F.get("w", F.col("i") + 1))
    rows = rows.select("doc_id", "y", "word", context.alias("context"))
    stems = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in STEM_LENGTHS]
    # of toxic rows all words are counted; of the others then only those that toxic rows have often
    toxic = rows.where("y = 1").withColumn("f", F.explode(F.array_compact(F.array("word", *stems))))
    toxic = toxic.groupBy("f", "context").agg(F.min("doc_id").alias("doc_id"))  # a context that copies share counts for one of them
    toxic = toxic.groupBy("f").agg(F.count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("contexts")).where((F.col("docs") >= 3) & (F.col("contexts") >= MIN_CONTEXTS))
    totals = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not totals.get(0) or not totals.get(1):
        return Lexicon(seed, {})
    clean = rows.where("y = 0").select("doc_id", F.explode(F.array_compact(F.array("word", *stems))).alias("f")).distinct()
    clean = clean.join(toxic.select("f"), "f", "left_semi").groupBy("f").agg(F.count(F.lit(1)).alias("clean_docs"))
    both = toxic.join(clean, "f", "left").select("f", "docs", "contexts", F.coalesce("clean_docs", F.lit(0)).alias("clean_docs"))
    share = totals[1] / (totals[0] + totals[1])
    k, n = F.least("docs", "contexts").cast("double"), F.least("docs", "contexts") + F.col("clean_docs")
    rate = k / n
    gain = k * F.log(rate / share) + F.when(rate < 1, (n - k) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    both = both.where((F.col("clean_docs") <= 0.05 * F.col("docs") * totals[0] / totals[1]) & (rate > share)).withColumn("gain", gain).where(F.col("gain") >= MIN_GAIN)
    out = Lexicon(dict(seed), {})
    for r in both.orderBy(F.desc("gain"), "f").collect():  # bounded by the sample
        purity = 1.0 - min(1.0, (r["clean_docs"] + 0.5) / totals[0] / ((r["docs"] + 0.5) / totals[1]))
        f, into = (r["f"][:-1], out.stems) if r["f"].endswith("*") else (r["f"], out.words)
        into[f] = max(into.get(f, 0.0), 0.4 + 0.6 * purity)
    return out


FEATURES = ("_tox_top", "_tox_total", "_tox_words")


def clause_features(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns of docs (with text) and the clause features of each row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.stems))  # bounded by the labelled sample
    schema = StructType([*docs.select(*keep).schema.fields, *(StructField(c, DoubleType()) for c in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Lexicon(*shared.value))
        for part in slices(batches, "text", max_bytes=2 << 20):
            f = reader.features(part.column("text"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x) for x in f.T)], names=[*keep, *FEATURES])

    return docs.select("text", *[c for c in keep if c != "text"]).mapInArrow(run, schema)


@dataclass
class Model:
    lexicon: Lexicon
    curve: tuple[float, ...]


def train_model(docs: DataFrame, labels: DataFrame) -> Model:
    rows = cut(training_rows(docs, labels, "toxic", PARTS, HELD, TRAIN_PER_CLASS))  # the only pass over the documents
    lexicon = learn_lexicon(rows)
    f: pd.DataFrame = clause_features(rows, lexicon, ("y", "weight")).toPandas()  # bounded by the sample
    return Model(lexicon, fit_curve(f[list(FEATURES)].to_numpy(float), f["y"].to_numpy(float), f["weight"].to_numpy(float)))


def score_column(curve: tuple[float, ...]):
    top, total, words = (F.col(c) for c in FEATURES)
    terms = [F.lit(1.0), F.least(top, F.lit(4.0)), F.log1p(total), F.log1p(total * 1000.0 / F.greatest(words, F.lit(50.0)))]
    z = sum((F.lit(float(b)) * t for b, t in zip(curve, terms)), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(z, F.lit(30.0)))))


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of each row of docs, whatever their names, with _tox_score and _tox_predicted."""
    out = clause_features(docs, model.lexicon, keep).withColumn("_tox_score", score_column(model.curve)).drop(*FEATURES)
    return out.withColumn("_tox_predicted", F.when(F.col("_tox_score") >= THRESHOLD, 1).otherwise(0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, train_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), PARTS) == HELD).alias("held_out"), F.col("_tox_score").alias("score"), F.col("_tox_predicted").alias("predicted"))
