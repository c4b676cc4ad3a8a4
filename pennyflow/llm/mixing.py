"""Mixing sources to target weights.

Tokens are summed per source; the targets follow the weights; every source then gets one repetition
rate, and a document is emitted floor(rate) times plus one copy with probability rate - floor(rate),
drawn by a hash of its id. All of it is DataFrame expressions.

Shape at scale: one aggregation to a row for each source (map-side combined, so a hot source is one
row of each task), sources ranked in ranges that are put behind each other, then a join of the documents with that small table. The table is broadcast only
when it is counted to be small; otherwise the join is left to Spark, which splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, column, cut, free_name, table, without

#: Source tables of at most so many rows are broadcast; a row takes under 200 bytes.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hash_unit(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key (null counts as empty) and the seed alone: 52 bits of MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def running(rows: DataFrame, order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """``rows`` with ``_at``, their number in the order from 1, and ``_before_<c>`` and ``_all_<c>``, the sums of the rows before and of all.

    Rows are dealt into ranges of the order, which are numbered and summed by themselves and then put
    behind each other, so that no task holds all rows. The frame is stored once, as ranges are drawn by sampling.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    each = dealt.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges, which are bounded by the shuffle partitions
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = each.select(
        "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"),
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_s_{c}") for c in sums], *[F.sum(f"_s_{c}").over(every).alias(f"_all_{c}") for c in sums],
    )
    within = Window.partitionBy("_range").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(each), "_range").withColumn("_at", F.col("_n") + F.row_number().over(within))
    for c in sums:
        out = out.withColumn(f"_before_{c}", F.col(f"_s_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return out.drop("_range", "_n", *[f"_s_{c}" for c in sums])


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Target and rate of each source.

    ``sizes`` has ``source`` and ``size``. Sources in code point order, null last, take the weights in
    turn. All targets sum to all sizes; a target stops at ``cap`` times its source's size and the
    excess is shared among the others by weight until none is above. A source without words has
    target and rate 0. Returns source, source_size, weight, target, rate: one row for each source.
    Any number of sources is ranked, range by range.
    """
    known = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = F.col("source").asc_nulls_last()
    ranked = running(known, [name], [])
    turn = (F.col("_at") - 1) % len(weights) + 1
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))).drop("_at")
    # Sources by the level at which they fill up: those before the first that doesn't are at their cap.
    ranked = ranked.withColumn("full", F.lit(float(cap)) * F.col("source_size")).withColumn("level", F.col("full") / F.col("weight"))
    ranked = cut(running(ranked, [F.col("level").asc(), name], ["source_size", "full", "weight"]))
    share = (F.col("_all_source_size") - F.col("_before_full")) / (F.col("_all_weight") - F.col("_before_weight"))
    ranked = ranked.withColumn("share", share)
    first = ranked.where(F.col("share") <= F.col("level")).agg(F.min_by("share", "_at").alias("first"))
    target = F.least(F.col("full"), F.coalesce(F.col("first") * F.col("weight"), F.col("full")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return ranked.crossJoin(F.broadcast(first)).withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, rate and copies.

    Null text has size 0, and so has one without words; texts of any length count whole. Null is a source
    of its own; a null id is hashed as an empty one. Repeated rows count each and, having one id, are copied
    alike. Columns of ``docs`` that are named as an output are dropped, all others stay. An empty table gives an empty table.
    """
    out = ("size", "source_size", "target", "rate", "copies")
    size, source, key = (free_name(docs, x) for x in ("_words", "_source", "_key"))
    sized = docs.withColumn(size, word_count(column(text_col))).withColumn(source, column(source_col))
    targets = source_targets(sized.select(F.col(source).alias("source"), F.col(size).alias("size")), weights, cap)
    targets = cut(targets.withColumnRenamed("source", key).drop("weight"))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    extra = F.when(hash_unit(column(id_col), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    copies = (F.floor("rate") + extra).cast("long").alias("copies")
    kept = [column(c) for c in docs.columns if c.lower() not in out]
    hidden = {c: free_name(sized, f"_{c}") for c in sized.columns if c.lower() in out}
    joined = sized.withColumnsRenamed(hidden).join(targets, F.col(source).eqNullSafe(F.col(key)))
    if id_col in hidden:
        raise ValueError(f"the id can't be named {id_col}")
    return joined.select(*kept, F.col(size).alias("size"), "source_size", "target", "rate", copies)


def emit_copies(planned: DataFrame) -> DataFrame:
    """The mix itself: each row as often as ``copies`` says, numbered from 1 in ``copy``; rows with 0 or null copies go.

    Repeated rows are each emitted; a column named ``copy`` is replaced, others stay, null or long as they are. An empty table gives an empty table.
    """
    planned = without(planned, ["copy"]).where("copies > 0")
    return planned.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def op2_mixing(spark, sf_dir):
    """Each document's size, its source's size and target, and the words that the mix takes from it."""
    planned = plan_mix(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s
), l AS (
  SELECT *, 3.0::DOUBLE * source_size AS filled, 3.0::DOUBLE * source_size / weight AS level FROM w
), h AS (
  SELECT *, row_number() OVER o AS pos,
    (sum(source_size) OVER () - coalesce(sum(filled) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
    sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM l WINDOW o AS (ORDER BY level, source NULLS LAST)
), f AS (
  SELECT share FROM h WHERE share <= level ORDER BY pos LIMIT 1
), t AS (
  SELECT source, source_size, least(filled, coalesce((SELECT share FROM f) * weight, filled)) AS target FROM h
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t
)
SELECT doc_id, size, source_size, target,
  (floor(rate)::BIGINT + CASE WHEN
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate)
    THEN 1 ELSE 0 END) * size AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
