"""Near-duplicate detection with SetSketch registers.

Each document's set of word shingles is sketched in REGISTERS registers: exponential minima, spaced exponentially with
base BASE and truncated to 16 bits. Registers are mergeable by maximum and collide with a probability close to the
Jaccard similarity, so ROWS of them make a band. Documents of equal sets are one class from the start. Classes that
share a band are candidates; the joint likelihood of the register comparisons estimates their similarity (Ertl, 2021)
and prunes far pairs; the others are confirmed on their full shingle sets.

Pairs are not enumerated within buckets. Each class points to the densest class (that with most bucket mates) of its
buckets, and along these pointers to a root. Roots are the densest in all of their buckets, so a group of near copies
has one root, however its members meet. Each class is compared with its root alone; links are joined into components.

Pairs across different components are then left. A class is described by its differences to its root: the shingles it
adds and those it lacks. With P the root's size, |u & v| <= P - max(lacks_u, lacks_v) + shared additions, and u and v link
if (a + b) |u & v| >= a (|u| + |v|) for a similarity a / b. So links share additions, unless both lie nearly within the root,
and then share an addition or enough of what they lack. In one order, rarest first, the first shared element must
leave room for the rest (prefix filter): the test is exact, and edits of one original share too little to pass it.
Classes that share a bucket across roots take the same test with an empty root. Of the classes that share a rare
element, each is first compared with one of them alone, so that a group far from its root becomes one component; only
pairs that are still across components are listed, pruned by the likelihood estimate and confirmed on full sets.

At a similarity of 0.85 a link shares no band with a probability of 6e-13 (0.8: 5e-9), and a link is
pruned by the estimate, which has six standard deviations of slack, with one below 1e-9.

Edge cases: null or empty texts, and texts without words, have an empty set, form no link and are their own
component, and `deduplicate` keeps all of them; with fewer words than a shingle has, the whole sequence is the only
shingle; rows that share a doc_id (or have none) are apart unless their texts are near: `deduplicate` keeps one row of
each group of near texts, whatever the ids; a null doc_id stands for the smallest long; an empty table gives an empty
result; extra columns are ignored, and kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vecspark.llm.common import WORD, binaries, cut, mix64, remove, shared_path, slices, span_hashes, table, text_bytes, words_of
from vecspark.llm.components import components

BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65_534
SLACK = 0.15
BROADCAST_ROOTS = 1_000_000  # of 8 bytes
NULL_KEY = -(2**63)
SKETCH = "k long, n long, h1 long, h2 long, bands array<long>, registers binary"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DRAW = np.random.default_rng(20210101)
_FACTORS = _DRAW.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAW.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    raw, offsets = text_bytes(texts)
    raw = _LOWER[raw]
    starts, lengths, first = words_of(raw, offsets)
    out = [np.empty(0, np.uint64)] * (len(offsets) - 1)
    if not starts.size:
        return out
    word = span_hashes(raw, starts, lengths)
    whole = span_hashes(word, first[:-1], np.minimum(np.diff(first), width - 1))  # of texts with too few words
    shingle = span_hashes(word, np.arange(max(0, word.size - width + 1)), np.full(max(0, word.size - width + 1), width))
    for k, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
        if b - a >= width:
            out[k] = np.unique(shingle[a : b - width + 1])
        elif b > a:
            out[k] = whole[k : k + 1]
    return out


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The size of each set and the halves of its 128-bit hash."""
    size = np.array([s.size for s in sets], np.int64)
    flat = np.concatenate(sets)
    at = np.append(0, np.cumsum(size))[:-1]
    return size, span_hashes(flat, at, size).view(np.int64), span_hashes(mix64(flat), at, size).view(np.int64)


def registers(values: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, values.size, 1024):
            hashes = values[a : a + 1024, None] * _FACTORS
            hashes += _SHIFTS
            least = np.minimum(least, hashes.min(0))
    draw = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(draw) / np.log(BASE)) + (1 << 14), 0, TOP).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def band_hashes(k: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.arange(BANDS, dtype=np.uint64)
        for row in k.reshape(BANDS, ROWS).T.astype(np.uint64):
            h = mix64(h * np.uint64(0x100000001B3) + row + np.uint64(1))
    return h.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarities of row pairs of registers, by maximum likelihood given the set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        p, q = chance(u - v * j), chance(v - u * j)
        tiny = 1e-12
        return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))

    low, high = np.zeros(len(a)), top.copy()
    for _ in range(40):  # the likelihood has one maximum
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(x) > likelihood(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """k (doc_id, null as the smallest long), set size, 128-bit set hash, band hashes and registers of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            size, h1, h2 = set_hashes(sets)
            k = [registers(s) if s.size else np.empty(0, np.uint16) for s in sets]
            bands = [band_hashes(x) if x.size else None for x in k]
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), pa.array(size), pa.array(h1), pa.array(h2), pa.array(bands, pa.list_(pa.int64())), binaries(np.concatenate(k), np.append(0, np.cumsum([x.size for x in k])))],
                names=["k", "n", "h1", "h2", "bands", "registers"],
            )

    return docs.select(F.coalesce("doc_id", F.lit(NULL_KEY).cast("long")).alias("k"), "text").mapInArrow(run, SKETCH)


def pair_sets(part: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingle sets of u and v of each row (u, v, text_u, text_v); a text that repeats is read once."""
    sides = []
    for c in ("u", "v"):
        _, first, inverse = np.unique(part.column(c).to_numpy(), return_index=True, return_inverse=True)
        sets = shingle_sets(part.column(f"text_{c}").take(pa.array(first)), width)
        sides.append([sets[i] for i in inverse.tolist()])
    return zip(*sides)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """Those of pairs (u, v, g, g2) that link; texts: (c, n, registers, text).

    The likelihood estimate over both sketches prunes far pairs, with SLACK to spare; the others are compared on their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_u", "text_v"):
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_u", "r_v"))
            j = estimate(a, b, part.column("n_u").to_numpy().astype(float), part.column("n_v").to_numpy().astype(float))
            part = part.filter(pa.array(j >= float(similarity) - SLACK))
            keep = []
            for a, b in pair_sets(part, width) if part.num_rows else ():
                both = np.intersect1d(a, b, assume_unique=True).size
                keep.append(similarity.denominator * both >= similarity.numerator * (a.size + b.size - both) and both > 0)
            yield part.select(["u", "v", "g", "g2"]).filter(pa.array(keep, pa.bool_()))

    of_u, of_v = texts.toDF("u", "n_u", "r_u", "text_u"), texts.toDF("v", "n_v", "r_v", "text_v")
    met = pairs.join(of_u, "u").join(of_v, "v").select("u", "v", "g", "g2", "n_u", "n_v", "r_u", "r_v", "text_u", "text_v")
    return met.mapInArrow(run, "u long, v long, g long, g2 long")


def differences(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """u, v, set sizes, size of the intersection, what u adds to v and what it lacks of it, of the pairs."""
    schema = "u long, v long, n_u long, n_v long, both long, adds array<long>, lacks array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_u", "text_v"):
            rows = []
            for a, b in pair_sets(part, width):
                both = np.intersect1d(a, b, assume_unique=True)
                rows.append((a.size, b.size, both.size, *(np.setdiff1d(x, both, assume_unique=True).view(np.int64) for x in (a, b))))
            n_u, n_v, both, adds, lacks = zip(*rows)
            counts = [pa.array(x, pa.int64()) for x in (n_u, n_v, both)]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (adds, lacks)]
            yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v"), *counts, *lists], names=["u", "v", "n_u", "n_v", "both", "adds", "lacks"])

    of_u, of_v = texts.select("c", "text").toDF("u", "text_u"), texts.select("c", "text").toDF("v", "text_v")
    return pairs.join(of_u, "u").join(of_v, "v").select("u", "v", "text_u", "text_v").mapInArrow(run, schema)


def whole_sets(texts: DataFrame, width: int) -> DataFrame:
    """(u, n, adds): the shingle set of each of texts (c, n, registers, text), as additions to an empty root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [x.view(np.int64) for x in shingle_sets(part.column("text"), width)]
            yield pa.RecordBatch.from_arrays([part.column("c"), pa.array([x.size for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["u", "n", "adds"])

    return texts.select("c", "text").mapInArrow(run, "u long, n long, adds array<long>")


def roots(star: DataFrame) -> DataFrame:
    """(u, v): the root v that each class u reaches along the pointers of star (u, v); a pointer leads to a denser class.

    Pointers are followed among the classes that are pointed to, in doubling steps."""
    ends = star.join(star.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    moved = 1
    while moved:
        next_ = ends.select(F.col("u").alias("v"), F.col("v").alias("w"))
        ends = cut(ends.select("u", "v").join(next_, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().cast("int").alias("moved")))
        moved = ends.agg(F.max("moved")).first()[0]
    return cut(star.join(ends.select(F.col("u").alias("v"), F.col("v").alias("w")), "v", "left").select("u", F.coalesce("w", "v").alias("v")))


def rare_first(members: DataFrame, column: str) -> DataFrame:
    """A row (grp, e, u, ..., i, size) for each element e of the array column that another member of the group grp has; i: its
    place among the member's elements, the rarest of the group first."""
    rows = members.select(*[c for c in members.columns if c not in ("adds", "lacks")], F.size(column).alias("size"), F.explode(column).alias("e"))
    often = rows.groupBy("grp", "e").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    rows = rows.join(often, ["grp", "e"])
    own = Window.partitionBy("grp", "u")
    # elements of one member alone come before all others
    place = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("f", "e"))
    return rows.withColumn("i", place).drop("f")


class PairTest:
    """The exact tests of pairs within a group (see above), as column expressions over the sizes n, the root's size p and the number of lacks l."""

    def __init__(self, similarity: Fraction):
        self.a, self.b = similarity.numerator, similarity.denominator
        self.ab = self.a + self.b

    def least_adds(self, n, l, p):  # noqa: E741
        """Additions that a member shares with any that it links to, if at least 1; else links within the root are possible."""
        smallest = F.ceil(n * self.a / self.b)
        return F.ceil((self.a * (n + smallest) - self.ab * (p - l)) / self.ab)

    def least_lacks(self, n, l, p):  # noqa: E741
        """Lacks that a member shares with any that it links to without a shared addition."""
        return F.greatest(F.lit(1), F.ceil((self.ab * l - self.b * p) / self.a + n))

    def sizes(self):
        return (F.col("n") * self.a <= F.col("n2") * self.b) & (F.col("n2") * self.a <= F.col("n") * self.b)

    def adds(self):
        """What two members must share of additions."""
        return (self.a * (F.col("n") + F.col("n2")) - self.ab * (F.col("p") - F.greatest("l", "l2"))) / self.ab

    def both(self):
        """What two members must share of additions and lacks together."""
        return (self.a * (F.col("n") + F.col("n2")) - self.ab * (F.col("p") - F.col("l") - F.col("l2"))) / self.ab

    def room(self):
        """Elements left from the shared one on."""
        return F.least(F.col("size") - F.col("i"), F.col("size2") - F.col("i2")) + 1

    def apart(self):
        """Of different components; and with an empty root, of different roots (others are compared by their own)."""
        return (F.col("g") != F.col("g2")) & ((F.col("grp") >= 0) | (F.col("r") != F.col("r2")))


def _second(rows: DataFrame, *same: str) -> DataFrame:
    return rows.select(*same, *[F.col(c).alias(c + "2") for c in ("u", "g", "r", "n", "l", "size", "i")])


def _pair(df: DataFrame) -> DataFrame:
    """(u, v, g, g2) of the pairs that met, once; g and g2: their components."""
    swap = F.col("u") > F.col("u2")
    order = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return df.select(order("u", "u2").alias("u"), order("u2", "u").alias("v"), order("g", "g2").alias("g"), order("g2", "g").alias("g2")).distinct()


def sharing_additions(rows: DataFrame, test: PairTest, star: bool) -> DataFrame:
    """Pairs of rows (of `rare_first`, cut to prefixes) with one element: all that may link, or only those with one of each element's rows."""
    other = rows.groupBy("grp", "e").agg(F.max(F.struct("u", "g", "r", "n", "l", "size", "i")).alias("x")).select("grp", "e", "x.*") if star else rows
    met = rows.join(_second(other, "grp", "e"), ["grp", "e"])
    may = test.apart() & test.sizes() & (test.room() >= test.adds())
    return _pair(met.where(may & (F.lit(True) if star else F.col("u") < F.col("u2"))))


def sharing_lacks(members: DataFrame, test: PairTest) -> DataFrame:
    """Pairs that may link without a shared addition: both lie nearly within their root, and lack the same of it.

    Such a pair's sizes are bounded by what each keeps of the root, so the smaller range of sizes is part of the key."""
    n, l, p = F.col("n"), F.col("l"), F.col("p")  # noqa: E741
    step = float(np.log(1.05))
    bucket = lambda x: F.floor(F.log(x) / step)
    largest = F.least(F.floor(n * test.b / test.a), F.floor((p - l) * test.ab / test.a) - n)
    smallest = F.ceil(n * test.a / test.b)
    inside = members.where((F.col("grp") >= 0) & (l > 0)).withColumn("largest", largest).where(F.col("largest") >= smallest)
    rows = rare_first(inside, "lacks").where(F.col("i") <= F.col("size") - test.least_lacks(n, l, p) + 1)
    rows = cut(rows)
    asked = rows.withColumn("range", F.explode(F.sequence(bucket(smallest.cast("double")), bucket(F.col("largest").cast("double")))))
    found = _second(rows.withColumn("range", bucket(n.cast("double"))), "grp", "e", "range")
    may = test.apart() & test.sizes() & (test.adds() <= 0) & (test.room() >= test.both())
    return _pair(asked.join(found, ["grp", "e", "range"]).where(may))


def relabelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with their label g replaced by the least of it and of those that links (g, g2) join it with: equal labels are connected."""
    both = links.select("g", "g2").unionAll(links.select(F.col("g2").alias("g"), F.col("g").alias("g2")))
    return rows.join(both.groupBy("g").agg(F.min("g2").alias("_g")), "g", "left").withColumn("g", F.least("g", "_g")).drop("_g")


def near_classes(docs: DataFrame, width: int, similarity: Fraction) -> tuple[DataFrame, DataFrame]:
    """(k, n, h1, h2) of each row of docs (doc_id, text), and (h1, h2, least) of each class: least (first, h1, h2) is the smallest k reachable over links and the class that has it."""
    spark = docs.sparkSession
    path = shared_path(spark, "sketches")
    sketch(docs, width).write.parquet(path)
    sketches = spark.read.parquet(path)
    classes = sketches.where("n > 0").groupBy("h1", "h2").agg(F.min("k").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
    class_path = shared_path(spark, "classes")
    classes.withColumn("c", F.monotonically_increasing_id()).write.parquet(class_path)
    classes = spark.read.parquet(class_path)

    # buckets of several classes, and how many bucket mates each class has
    entries = classes.select("c", F.explode("bands").alias("b"))
    counts = entries.groupBy("b").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1")
    entries = cut(entries.join(counts, "b"))
    density = entries.groupBy("c").agg(F.sum("mates").alias("density"))
    entries = cut(entries.select("b", "c").join(density, "c"))
    densest = entries.groupBy("b").agg(F.max(F.struct("density", "c")).alias("rep"))
    star = entries.join(densest, "b").select("c", "rep").groupBy("c").agg(F.max("rep").alias("rep"))
    star = cut(star.select(F.col("c").alias("u"), F.col("rep.c").alias("v")))  # a row for each class that has bucket mates
    wanted = star.select(F.col("u").alias("c"))
    star = roots(star.where("u <> v"))

    # texts of the classes that have candidates: the only pass that shuffles whole texts
    text_path = shared_path(spark, "texts")
    wanted = classes.select("first", "c", "h1", "n", "registers").join(wanted, "c", "left_semi")
    source = docs.select(F.coalesce("doc_id", F.lit(NULL_KEY).cast("long")).alias("first"), "text")
    with_text(source.join(wanted, "first"), width).write.option("compression", "zstd").parquet(text_path)
    texts = spark.read.parquet(text_path).select("c", "n", "registers", "text")

    star_path = shared_path(spark, "star")
    num, den = similarity.numerator, similarity.denominator
    linked = (F.lit(den) * F.col("both") >= F.lit(num) * (F.col("n_u") + F.col("n_v") - F.col("both"))) & (F.col("both") > 0)
    star = differences(star, texts, width).withColumn("g", F.when(linked, F.col("v")).otherwise(F.col("u")))
    star.write.option("compression", "zstd").parquet(star_path)
    star = spark.read.parquet(star_path)
    rooted = star.select("u", F.col("v").alias("r"), "g")

    # members of roots that hold several components, and of buckets that hold several components of different roots
    described = star.select("u", F.col("v").alias("grp"), F.col("v").alias("r"), F.col("n_u").alias("n"), F.col("n_v").alias("p"), (F.col("n_v") - F.col("both")).alias("l"), "adds", "lacks", "g")
    split = rooted.groupBy("r").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1").select(F.col("r").alias("grp"))
    placed = entries.select("b", F.col("c").alias("u")).join(rooted, "u", "left")
    placed = cut(placed.select("b", "u", F.coalesce("r", "u").alias("r"), F.coalesce("g", "u").alias("g")))
    mixed = placed.groupBy("b").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.min("r").alias("r0"), F.max("r").alias("r1")).where("g0 <> g1 AND r0 <> r1")
    across = cut(placed.join(mixed.select("b"), "b", "left_semi").select("u", "g", "r").distinct())
    whole = whole_sets(texts.join(across.select(F.col("u").alias("c")), "c", "left_semi"), width).join(across, "u")
    whole = whole.select("u", F.lit(-1).cast("long").alias("grp"), "r", "n", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("l"), "adds", F.array().cast("array<long>").alias("lacks"), "g")
    member_path = shared_path(spark, "members")
    split = cut(split)
    if split.count() <= BROADCAST_ROOTS:
        split = F.broadcast(split)  # so that the members of a large root stay dealt over all tasks
    described.join(split, "grp", "left_semi").select(*whole.columns).unionAll(whole).write.option("compression", "zstd").parquet(member_path)
    members = spark.read.parquet(member_path)

    test = PairTest(similarity)
    rows = rare_first(members, "adds")
    rows = cut(rows.where(F.col("i") <= F.col("size") - F.greatest(F.lit(1), test.least_adds(F.col("n"), F.col("l"), F.col("p"))) + 1))
    first_links = cut(confirmed(sharing_additions(rows, test, star=True), texts, width, similarity))
    rows = relabelled(rows, first_links)
    split = rows.groupBy("grp", "e").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1").select("grp", "e")
    rows = cut(rows.join(split, ["grp", "e"], "left_semi"))
    near = sharing_additions(rows, test, star=False).unionAll(sharing_lacks(relabelled(members, first_links), test))
    links = first_links.unionAll(confirmed(near.distinct(), texts, width, similarity))
    # roots and what links to them are components already; the links that were found later join some of these
    merged = components(links.select(F.col("g").alias("u"), F.col("g2").alias("v")))
    every = rooted.select("u", "g").unionAll(rooted.select(F.col("r").alias("u"), F.col("r").alias("g")).distinct())
    merged = every.join(merged.toDF("g", "component"), "g", "left").select(F.col("u").alias("node"), F.coalesce("component", "g").alias("component"))

    named = classes.select("h1", "h2", "c", "first").join(merged.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    named = cut(named)
    smallest = cut(named.groupBy("component").agg(F.min(F.struct("first", "h1", "h2")).alias("least")))
    named = cut(named.join(smallest, "component").select("h1", "h2", "least"))
    remove(spark, class_path, text_path, star_path, member_path)
    return sketches.select("k", "n", "h1", "h2"), named


def near_components(docs: DataFrame, width: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """(k, n, component) of each row of docs (doc_id, text): set size and the smallest k reachable over links."""
    rows, named = near_classes(docs, width, similarity)
    out = rows.join(named.select("h1", "h2", F.col("least.first").alias("least")), ["h1", "h2"], "left")
    return out.select("k", "n", F.coalesce("least", "k").alias("component"))


def with_text(rows: DataFrame, width: int) -> DataFrame:
    """(c, n, registers, text) of rows (text, c, h1, n, registers) whose text has the class's set: of rows that repeat a doc_id only the right ones, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            size = np.array([s.size for s in sets], np.int64)
            h1 = span_hashes(np.concatenate(sets), np.append(0, np.cumsum(size))[:-1], size).view(np.int64)
            yield part.select(["c", "n", "registers", "text"]).filter(pa.array(h1 == part.column("h1").to_numpy()))

    return rows.select("c", "n", "registers", "text", "h1").mapInArrow(run, "c long, n long, registers binary, text string").dropDuplicates(["c"])


def deduplicate(docs: DataFrame, width: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """One document of each group of near texts, of the smallest doc_id, and all documents without words; whole rows of docs."""
    named = near_classes(docs.select("doc_id", "text"), width, similarity)[1]
    keys = ["_near_k", "_near_h1", "_near_h2"]
    kept = named.select("least.*").distinct().toDF(*keys)
    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            _, h1, h2 = set_hashes(shingle_sets(part.column("text"), width))
            k = pc.fill_null(part.column("doc_id").cast(pa.int64()), NULL_KEY)
            yield pa.RecordBatch.from_arrays([*part.columns, k, pa.array(h1), pa.array(h2)], names=[*part.schema.names, *keys])

    worded = F.coalesce("text", F.lit("")).rlike(WORD)
    out = docs.where(worded).mapInArrow(run, schema).join(kept, keys, "left_semi").dropDuplicates(keys)
    return out.select(*docs.columns).unionAll(docs.where(~worded))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_components(docs, 3, Fraction(85, 100))
    real = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return out.select(real("k").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("k") == F.col("component")).alias("kept"))


OP8_SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, coalesce(doc_id, -9223372036854775808) AS k,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT n, array_to_string(w[i : i + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(w), 3) - 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT n, count(*) AS size FROM shingles GROUP BY n),
common AS (SELECT a.n, b.n AS m, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.n <> b.n GROUP BY ALL),
links AS (SELECT common.n, m FROM common JOIN sizes a ON a.n = common.n JOIN sizes b ON b.n = m WHERE 100 * c >= 85 * (a.size + b.size - c)),
reached AS (SELECT n, n AS m FROM d UNION SELECT reached.n, links.m FROM reached JOIN links ON links.n = reached.m),
least AS (SELECT reached.n, min(d.k) AS component FROM reached JOIN d ON d.n = reached.m GROUP BY reached.n)
SELECT nullif(k, -9223372036854775808) AS doc_id, coalesce(size, 0)::BIGINT AS n_shingles, nullif(component, -9223372036854775808) AS component_id, k = component AS kept
FROM d JOIN least USING (n) LEFT JOIN sizes USING (n)"""
