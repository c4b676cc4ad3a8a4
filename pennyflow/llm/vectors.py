"""What the operators on embeddings share: rows that take part, vectors as matrices, sums over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches


def finite(vector: str) -> Column:
    """Whether a vector is there and holds neither a null nor a non-finite number."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def common_length(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, of equally frequent ones the longest; 0 if no vector holds a number."""
    sizes = rows.groupBy(F.size(vector).alias("length")).count().where("length > 0")
    most = sizes.orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return most[0]["length"] if most else 0


def floored(vector: str, scale: int) -> Column:
    """Each number as the long floor(scale * number); beyond a long's range its nearest bound."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A column of equally long arrays as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def summed(df: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: str = "double") -> dict[int, object]:
    """The entrywise sum over all tasks of the flat arrays that ``add`` makes of a task's batches, by position.

    ``kind`` is ``double``, or ``decimal(38,0)`` for whole numbers that have to stay exact. Every task gives one
    array and Spark adds them up; the driver gets as many numbers as one array holds. Zeros aren't sent.
    """
    small_batches(df.sparkSession)
    exact = kind != "double"
    held = pa.decimal128(38, 0) if exact else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.asarray(add(batches)).ravel()
        at = np.flatnonzero(total)
        values = pa.array([int(v) for v in total[at]] if exact else total[at], held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), values], names=["at", "value"])

    parts = df.mapInArrow(run, f"at int, value {kind}")
    # A sum of decimals is given 38 digits whatever it holds.
    return {r["at"]: r["total"] for r in parts.groupBy("at").agg(F.sum("value").alias("total")).collect()}
