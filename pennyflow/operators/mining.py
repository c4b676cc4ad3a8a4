"""Keyword mining in descriptions: n-grams, document frequency, IDF, string similarity."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import ngrams

#: Keywords are in at most this share of the rows and occur at least so often. Fixed values.
MOST_SHARE, LEAST_COUNT = 0.3, 3


def keywords(rows: DataFrame, text_col: str, longest: int = 3) -> DataFrame:
    """Terms of one to ``longest`` words with their count, document frequency and IDF, ln(rows / df)."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.col(text_col)), r"[^\w]+", " ")), " ")
    grams = rows.select(words.alias("w")).select(F.flatten(F.array(*[ngrams(F.col("w"), n) for n in range(1, longest + 1)])).alias("g"))
    each = F.transform(F.array_distinct("g"), lambda t: F.struct(t.alias("term"), F.size(F.filter("g", lambda x: x == t)).alias("n")))
    counted = grams.select(F.explode(each).alias("e")).select("e.term", "e.n")
    out = counted.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df")).where(F.col("n") >= LEAST_COUNT)
    out = out.crossJoin(F.broadcast(rows.agg(F.count("*").alias("__rows")))).where(F.col("df") <= F.floor(MOST_SHARE * F.col("__rows")))
    return out.withColumn("idf", F.round(F.ln(F.col("__rows").cast("double") / F.col("df")), 6)).drop("__rows")


def similarity_of(a: str, b: str) -> float:
    """100 for equal texts, 90 if one holds the other, else the larger of matching-blocks ratio and word overlap."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 100.0
    if a in b or b in a:
        return 90.0
    x, y = set(a.split()), set(b.split())
    return 100 * max(SequenceMatcher(None, a, b).ratio(), len(x & y) / max(1, len(x | y)))


@F.pandas_udf(DoubleType())
def similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``similarity_of`` two columns; null with a null."""
    for a, b in parts:
        yield pd.Series([similarity_of(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")
