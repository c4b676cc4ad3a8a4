"""Keyed writes expressed as the table that they leave: insert-if-absent, upsert, partial upsert, deletes.

Each returns the new table; ``sources.feeds.replace_table`` writes it beside the old one and then swaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _once(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row of each key: the first by all other columns."""
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    first = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__first"))
    return first.select(*[F.col(c) if c in key else F.col(f"__first.{c}").alias(c) for c in rows.columns])


def insert_new(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``target`` and those of ``rows`` whose key it lacks; the first by all columns of equal keys. Running it twice changes nothing."""
    return target.unionByName(_once(rows, key).join(target.select(*key), list(key), "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows``, of equal keys the first by all columns, and those of ``target`` whose key they lack: the key stays unique."""
    return target.join(rows.select(*key), list(key), "left_anti").unionByName(_once(rows, key))


def upsert_columns(target: DataFrame, rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """As ``upsert``, but rows that exist change in ``columns`` only, and there only to values that aren't null. Columns that ``rows`` lack are null in new rows."""
    new = _once(rows, key).select(*key, *[F.col(c).alias(f"__{c}") for c in rows.columns if c not in key], F.lit(True).alias("__new"))
    both = target.withColumn("__old", F.lit(True)).join(new, list(key), "full")
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.col(c))
        elif c in columns:
            out.append(F.coalesce(f"__{c}", c).alias(c))
        else:
            out.append(F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}") if c in rows.columns else F.lit(None)).alias(c))
    return both.select(*out)


def retained(rows: DataFrame, matched: DataFrame, key: str, deletable: Column) -> DataFrame:
    """``rows`` without the unmatched ones that ``deletable`` names; null there keeps a row."""
    gone = rows.where(deletable).join(matched.select(key), key, "left_anti").select(key)
    return rows.join(gone, key, "left_anti")


def page(rows: DataFrame, order: Sequence, number: int, size: int) -> DataFrame:
    """One page, with the total and the number of pages on every row; ``order`` has to be total."""
    totals = rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(totals)
