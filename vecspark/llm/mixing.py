"""Mixing sources to target weights.

Tokens are summed per source, capped shares are solved by water-filling over the (small) per-source table, and
each document is emitted floor(rate) times plus one copy more with probability equal to the rate's fraction; the
draw is a hash of seed and doc_id, so reruns and retried tasks agree.

Edge cases: a null source is a source of its own, ordered last; a null or empty text has size 0 and is emitted like
any other document; repeated rows of one doc_id share one draw; a null doc_id draws as the text "null"; sources of
no words get target 0 and rate 0; an empty table gives an empty result. Columns other than doc_id, text and source
pass through `mix` untouched; working columns carry the prefix `_mix_`, which inputs must not use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.llm.common import cut, n_words, table

WEIGHTS = (3, 1, 2)
SHARE_HALVES = 3  # targets sum to 3/2 of all sizes
CAP = 2
SEED = "mix-1"
#: Up to so many sources (one row of some 50 bytes each) the targets are broadcast; beyond, they are joined with salt.
BROADCAST_SOURCES = 100_000
SALTS = 64


def source_targets(sized: DataFrame, weights=WEIGHTS, share_halves: int = SHARE_HALVES, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows of (source, size); all windows run over one row per source."""
    n = len(weights)
    total = Window.partitionBy(F.lit(0))
    by_name = total.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(n))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("decimal(38,0)")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", weight)
    s = s.withColumn("cap", (F.col("source_size") * cap).cast("decimal(38,0)"))
    before = total.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    big = lambda c: c.cast("decimal(38,0)")
    s = (
        s.withColumn("all_size", big(F.sum("source_size").over(total)))
        .withColumn("all_w", big(F.sum("w").over(total)))
        .withColumn("cap_before", big(F.coalesce(F.sum("cap").over(before), zero)))
        .withColumn("w_before", big(F.coalesce(F.sum("w").over(before), zero)))
        .withColumn("pos", F.count(F.lit(1)).over(before))
    )
    # twice the words left and the weight left when all sources with smaller cap per weight are at their caps
    s = s.withColumn("left2", big(F.col("all_size") * share_halves - F.col("cap_before") * 2)).withColumn("left_w", big(F.col("all_w") - F.col("w_before")))
    s = s.withColumn("capped", big(F.col("cap") * 2 * F.col("left_w")) <= big(F.col("w") * F.col("left2")))
    level = F.min(F.when(~F.col("capped"), F.struct("pos", F.col("left2").cast("double").alias("a"), (F.col("left_w") * 2).cast("double").alias("b")))).over(total)
    s = s.withColumn("level", level)
    first = F.col("level.pos")
    target = F.when(first.isNull() | (F.col("pos") < first), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * F.col("level.a") / F.col("level.b"))
    return s.select("source", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, seed: str = SEED, weights=WEIGHTS) -> DataFrame:
    """docs plus _mix_size, _mix_source_size, _mix_target and _mix_copies."""
    sized = docs.select("source", n_words(F.col("text")).alias("size"))
    targets = cut(source_targets(sized, weights)).select(
        F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target")
    )
    docs = docs.withColumn("_mix_size", n_words(F.col("text")))
    same = F.col("source").eqNullSafe(F.col("_mix_source"))
    if targets.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(targets), same)
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        spread = targets.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        joined = docs.join(spread, same & (salt == F.col("_mix_salt"))).drop("_mix_salt")
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(0.0)
    whole = F.floor(rate)
    return joined.withColumn("_mix_copies", whole + F.when(draw < rate - whole, 1).otherwise(0)).drop("_mix_source")


def mix(docs: DataFrame, seed: str = SEED, weights=WEIGHTS) -> DataFrame:
    """The mixed corpus: docs with each row repeated as often as the mix takes it."""
    columns = docs.columns
    out = with_copies(docs, seed, weights)
    out = out.where("_mix_copies > 0").withColumn("_mix_nr", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
    return out.select(*columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = with_copies(docs)
    return out.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_copies") * F.col("_mix_size")).cast("long").alias("taken"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS w,
    (2 * source_size)::HUGEINT AS cap FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER ())::HUGEINT AS all_size, (sum(w) OVER ())::HUGEINT AS all_w,
    coalesce(sum(cap) OVER b, 0)::HUGEINT AS cap_before, coalesce(sum(w) OVER b, 0)::HUGEINT AS w_before, count(*) OVER b AS pos
  FROM s1 WINDOW b AS (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, 3 * all_size - 2 * cap_before AS left2, all_w - w_before AS left_w FROM s2
), lv AS (
  SELECT pos, left2::DOUBLE AS a, (2 * left_w)::DOUBLE AS b FROM s3 WHERE NOT (cap * 2 * left_w <= w * left2) ORDER BY pos LIMIT 1
), t AS (
  SELECT s3.source, source_size, CASE WHEN lv.pos IS NULL OR s3.pos < lv.pos THEN cap::DOUBLE ELSE w::DOUBLE * lv.a / lv.b END AS target
  FROM s3 LEFT JOIN lv ON TRUE
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
