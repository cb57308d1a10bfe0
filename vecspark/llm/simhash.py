"""SimHash document fingerprints, in DataFrame functions only.

Terms are the lower-cased words of a text; a term votes with its length (at most MAX_WEIGHT) on each of the 64 bits of
its hash, and a fingerprint bit is set where the set votes outweigh the others. Votes are summed as 32 long sums of
two 32-bit lanes each, right above the generated term rows and before any exchange, so the terms are never shuffled.

`neighbours` finds all pairs of distinct fingerprints within a Hamming radius: the 64 bits are cut into blocks, and a
table is kept for every choice of blocks - radius blocks, permuted to the front as its key; two fingerprints within
the radius agree in all bits of at least one such choice, so the search is exact. Copies meet as one fingerprint. `op7`
counts by it, for each document, the other fingerprints of the table within RADIUS bits (n_near).

Edge cases: a null text counts as empty; a text without words has fingerprint 0; equal texts have equal fingerprints;
rows that repeat a doc_id share the next document, which is the least text of the next larger doc_id, and each gives
a row; a null doc_id comes before all others (and stands for the smallest long); the only document of a table follows itself; an empty table gives an
empty result. Weights of up to 2**31 per text (some 100 million words) are exact. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.llm.common import cut, table

MAX_WEIGHT = 16
BITS = 64
LANES = 32
RADIUS = 3
GAP = r"[\x20\x09-\x0D]+"
FIRST_KEY = -(2**63)


def words(text):
    return F.split(F.lower(text), GAP)


def vote_sums(term, condition=None):
    """The 32 lane sums and the sum of weights over rows of terms, optionally only of those that fulfil condition."""
    h = F.xxhash64(term)
    weight = F.least(F.length(term), F.lit(MAX_WEIGHT)).cast("long")
    if condition is not None:
        weight = F.when(condition, weight).otherwise(F.lit(0).cast("long"))

    def lane(i):
        low = F.shiftrightunsigned(h, i).bitwiseAND(F.lit(1))
        high = F.shiftrightunsigned(h, i + LANES).bitwiseAND(F.lit(1))
        return F.sum(weight * low + F.shiftleft(weight * high, 32))

    return [lane(i) for i in range(LANES)], F.sum(weight)


def fingerprint(lanes, weight):
    """The 64-bit fingerprint from vote sums."""
    out = F.lit(0).cast("long")
    for i, lane in enumerate(lanes):
        low, high = lane.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(lane, 32)
        for bit, votes in ((i, low), (i + LANES, high)):
            value = 1 << bit if bit < 63 else -(2**63)
            out = out.bitwiseOR(F.when(votes * 2 > weight, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def as_hex(fp):
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def likeness(a, b):
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint long) of each row of docs (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", F.xxhash64("text", F.length("text")).alias("row"), F.posexplode(words(F.col("text"))).alias("pos", "term")
    )
    lanes, weight = vote_sums(F.col("term"))
    votes = rows.groupBy("doc_id", "row").agg(*[x.alias(f"v{i}") for i, x in enumerate(lanes)], weight.alias("w"), F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("n"))
    fp = fingerprint([F.col(f"v{i}") for i in range(LANES)], F.col("w"))
    return votes.select("doc_id", fp.alias("fingerprint"), "n").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")


def neighbours(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(a, b, distance) for all distinct fingerprints a < b of prints (fingerprint long) within the radius, without a cap.

    Documents join the pairs by their fingerprint, so copies are never expanded into pairs."""
    blocks = blocks or radius + 3
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    tables = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        tables.append(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))
    keyed = prints.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
    keyed = keyed.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(m) for m in tables])).alias("table", "key"))
    a, b = keyed.withColumnRenamed("fingerprint", "a"), keyed.withColumnRenamed("fingerprint", "b")
    pairs = a.join(b, ["table", "key"]).where("a < b").withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))
    return pairs.where(F.col("distance") <= radius).select("a", "b", "distance").distinct()


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, n_near): the number of other distinct fingerprints within the radius, of those that have any."""
    pairs = neighbours(prints, radius)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fingerprint"))
    return ends.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_near"))


def succession(docs: DataFrame) -> DataFrame:
    """(k, next_k, prev_k, prev_n) of each distinct doc_id: its neighbours in ascending order, the last followed by the first."""
    key = F.coalesce(F.col("doc_id"), F.lit(FIRST_KEY).cast("long"))
    ids = docs.select(key.alias("k"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).groupBy("k").agg(F.max("n").alias("n"))
    # the range bounds are sampled, so the partition numbers are made once and kept
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = cut(ids.repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy("k")
    ends = ids.groupBy("part").agg(F.min("k").alias("first_k"), F.max_by("n", "k").alias("last_n"), F.max("k").alias("last_k"))
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy("part")  # one row per range partition
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first_k").over(order), F.min("first_k").over(every)).alias("after_k"),
        F.coalesce(F.lag("last_k").over(order), F.max("last_k").over(every)).alias("before_k"),
        F.coalesce(F.lag("last_n").over(order), F.max_by("last_n", "last_k").over(every)).alias("before_n"),
    )
    ids = ids.withColumn("next_k", F.lead("k").over(within)).withColumn("prev_k", F.lag("k").over(within)).withColumn("prev_n", F.lag("n").over(within))
    ids = ids.join(F.broadcast(ends), "part")  # ends: a row of 40 bytes per range partition
    return ids.select(
        "k",
        F.coalesce("next_k", "after_k").alias("next_k"),
        F.coalesce("prev_k", "before_k").alias("prev_k"),
        F.coalesce("prev_n", "before_n").alias("prev_n"),
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id"), F.lit(FIRST_KEY).cast("long"))
    rows = docs.select(key.alias("k"), F.coalesce("text", F.lit("")).alias("text"))  # the same columns on both sides, so that one exchange of texts serves them
    order = cut(succession(docs))
    rows = rows.join(order.select("k", "prev_k", "prev_n"), "k")
    # what a document takes of the next one is at most this head, so whole texts travel once
    heads = rows.groupBy("k").agg(F.min(F.struct("text", "prev_k", "prev_n")).alias("x"))
    heads = heads.select(F.col("x.prev_k").alias("k"), F.xxhash64("x.text").alias("next_row"), F.expr("substring(x.text, 1, cast(x.prev_n div 2 as int))").alias("head"))
    rows = rows.select("k", "text", F.length("text").alias("n")).join(heads, "k")
    rows = rows.withColumn("half", F.expr("n div 2").cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, n - half)"), F.expr("substring(head, 1, half)")))
    rows = rows.select(
        "k", F.col("n").cast("long").alias("n_chars"), F.xxhash64("text").alias("row"), F.sha2("edited", 256).alias("edited_sha256"), "next_row", words(F.col("text")).alias("a"), words(F.col("edited")).alias("b")
    )
    rows = rows.select("k", "row", "next_row", "n_chars", "edited_sha256", F.size("a").alias("n_a"), F.posexplode(F.concat("a", "b")).alias("pos", "term"))
    own = F.col("pos") < F.col("n_a")
    (own_lanes, own_w), (new_lanes, new_w) = vote_sums(F.col("term"), own), vote_sums(F.col("term"), ~own)
    votes = rows.groupBy("k", "row", "next_row", "n_chars", "edited_sha256").agg(
        *[x.alias(f"a{i}") for i, x in enumerate(own_lanes)], *[x.alias(f"b{i}") for i, x in enumerate(new_lanes)],
        own_w.alias("a_w"), new_w.alias("b_w"), F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("n_rows"),
    )
    fp = lambda p: fingerprint([F.col(f"{p}{i}") for i in range(LANES)], F.col(f"{p}_w"))
    out = cut(votes.select("k", "n_chars", "edited_sha256", "row", "next_row", fp("a").alias("fp"), fp("b").alias("edited_fp"), "n_rows"))
    # the next document's fingerprint: of rows that repeat a doc_id, that of the text whose head was taken
    texts = out.select(F.col("k").alias("next_k"), F.col("row").alias("next_row"), F.col("fp").alias("next_fp")).distinct()
    near = near_counts(out.select(F.col("fp").alias("fingerprint"))).withColumnRenamed("fingerprint", "fp")
    out = out.join(order.select("k", "next_k"), "k").join(texts, ["next_k", "next_row"]).join(near, "fp", "left")
    out = out.select(
        F.when(F.col("k") != FIRST_KEY, F.col("k")).alias("doc_id"), "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("copy"),
    )
    return out.drop("copy")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
