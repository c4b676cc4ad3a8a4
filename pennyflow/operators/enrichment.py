"""Enrichment from several sources: which value counts, which source is primary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesced(rows: DataFrame, sources: Sequence[DataFrame], key: str, value: str, default: str | None = None) -> DataFrame:
    """``rows`` with ``value`` from the first source that has one. Each source has at most one row for a key."""
    out, names = rows, []
    for k, source in enumerate(sources):
        names.append(f"__v{k}")
        out = out.join(source.select(key, F.col(value).alias(names[-1])), key, "left")
    last = [F.lit(default)] if default is not None else []
    return out.withColumn(value, F.coalesce(*[F.col(n) for n in names], *last)).drop(*names)


def primary_source(sources: DataFrame, key: str, order: Sequence) -> DataFrame:
    """The one primary source of each key: the first by ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return sources.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def source_list(sources: DataFrame, key: str, label: str, order: str, out: str = "sources") -> DataFrame:
    """Each key's sources as one text, in order: ``A | B``."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(label))))
    return sources.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x[label]), " | ").alias(out))


def suggested(rows: DataFrame, known: DataFrame, tiers: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``rows`` with class, confidence and reason from the first tier that knows: (reason, key column, weight of its share).

    A tier's class is the commonest of the key's ``known`` rows, the first by name of equals; its share,
    weighted and rounded to two places, is the confidence. Rows that no tier knows have nulls.
    """
    rows, found = rows.drop("class"), []
    for k, (reason, key, weight) in enumerate(tiers):
        counts = known.where(F.col(key).isNotNull()).groupBy(key, "class").agg(F.count("*").alias("n"))
        best = counts.groupBy(key).agg(F.min_by(F.struct("class", "n"), F.struct(-F.col("n"), "class")).alias("b"), F.sum("n").alias("every"))
        share = F.round(F.col("b.n").cast("decimal(18,4)") / F.col("every"), 4) * F.lit(weight).cast("decimal(2,1)")
        rows = rows.join(best.select(key, F.struct(F.col("b.class").alias("class"), F.round(share, 2).cast("double").alias("confidence"), F.lit(reason).alias("reason")).alias(f"__t{k}")), key, "left")
        found.append(F.col(f"__t{k}"))
    out = F.coalesce(*found)
    return rows.withColumns({n: out[n] for n in ("class", "confidence", "reason")}).drop(*[f"__t{k}" for k in range(len(tiers))])
