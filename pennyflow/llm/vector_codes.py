"""Vector codes: each part of a vector is replaced by the number of its nearest codebook entry, found exactly behind segment-mean lower bounds.

A part of L integers is cut into blocks. By the sums of the blocks and the norm of what the blocks' means leave,
the squared distance of two parts is at least ``sum (s - t)**2 / width + (r - q)**2``. Bounds with one block come first, for all
entries; the entry of the least bound is measured exactly, which gives an upper bound; entries whose bound is above it are out, and
the rest meet bounds with twice as many blocks, until blocks are two wide. Bounds are computed in doubles and lowered by more than
rounding can raise them, so no nearest entry is ever filtered. What survives is measured in whole numbers, ties to the lower index.

Codebooks are learned over all rows: each round is one pass whose tasks give counts and sums for each entry, added up by Spark.
The driver holds the codebooks alone: entries times dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, dropped, small_batches, stored, table
from .vectors import common_length, finite, floored, matrix, summed

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: By how much bounds are lowered, relative to the numbers that they come from: rounding stays a thousand times below.
SLACK = 1e-10
#: Labels up to this number are joined by broadcast; more of them by shuffle, every label's rows dealt to so many keys.
BROADCAST_LABELS, SALTS = 1_000_000, 64


def sketches(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sums of blocks, the blocks' widths and the norm of what their means leave, with 1, 2, 4, ... blocks while they are two wide."""
    length, squares, out, blocks = x.shape[1], (x * x).sum(axis=1), [], 1
    while blocks == 1 or length // blocks >= 2:
        starts = np.arange(blocks) * length // blocks
        widths = np.diff(np.append(starts, length)).astype(np.float64)
        sums = np.add.reduceat(x, starts, axis=1)
        out.append((sums / np.sqrt(widths), widths, np.sqrt(np.maximum(squares - (sums * sums / widths).sum(axis=1), 0.0))))
        blocks *= 2
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, in longs where they can't overflow, else in Python's whole numbers."""
    most = max((float(np.abs(a.astype(np.float64)).max()) for a in (x, y) if a.size), default=0.0)
    if (2 * most) ** 2 * x.shape[1] >= 2.0**62:
        x, y = x.astype(object), y.astype(object)
    return ((x - y) ** 2).sum(axis=1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row, its exact squared distance, and how many exact distances it took."""
    mine, theirs = x.astype(np.float64), entries.astype(np.float64)
    size, entry_size = (mine * mine).sum(axis=1), (theirs * theirs).sum(axis=1)
    own, other = sketches(mine), sketches(theirs)
    (s, _, r), (t, _, q) = own[0], other[0]
    slack = SLACK * (size[:, None] + entry_size[None, :])
    lower = (s - t.T) ** 2 + (r[:, None] - q[None, :]) ** 2 - slack
    first = lower.argmin(axis=1)
    upper = distances(x, entries[first])
    above = upper.astype(np.float64)
    row, entry = np.nonzero(lower <= above[:, None])
    for (s, _, r), (t, _, q) in zip(own[1:], other[1:], strict=True):
        bound = ((s[row] - t[entry]) ** 2).sum(axis=1) + (r[row] - q[entry]) ** 2 - slack[row, entry]
        left = bound <= above[row]
        row, entry = row[left], entry[left]
    exact = distances(x[row], entries[entry])
    order = np.lexsort((entry, exact, row)) if exact.dtype != object else np.array(sorted(range(len(row)), key=lambda k: (row[k], exact[k], entry[k])), np.int64)
    row, entry, exact = row[order], entry[order], exact[order]
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
    return entry[head], exact[head], len(x) + len(row)


def cut_parts(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows as (row, part, position), zeros after the last number where parts would be unequal."""
    wide = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, wide * parts - x.shape[1]))).reshape(len(x), parts, wide)


def learned(kept: DataFrame, start: np.ndarray, rounds: int, length: int) -> np.ndarray:
    """Codebooks (part, entry, position) after so many rounds over all rows, each entry the floor of its parts' mean; unused ones stay."""
    books = start
    parts, k, wide = books.shape
    for _ in range(rounds):
        held = kept.sparkSession.sparkContext.broadcast(books)

        def add(batches: Iterator[pa.RecordBatch], held=held) -> np.ndarray:
            total = np.zeros((parts, k, wide + 1), object)
            for batch in batches:
                x = cut_parts(matrix(batch.column("x"), length), parts)
                if not len(x):
                    continue
                small = float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0**62
                for p in range(parts):
                    chosen, _, _ = nearest(x[:, p], held.value[p])
                    for e in np.unique(chosen):
                        own = x[chosen == e, p]
                        total[p, e, :wide] += (own if small else own.astype(object)).sum(axis=0).astype(object)
                        total[p, e, wide] += len(own)
            return total

        flat = np.zeros(parts * k * (wide + 1), object)
        for at, value in summed(kept, add, "decimal(38,0)").items():
            flat[at] = int(value)
        held.destroy()
        sums = flat.reshape(parts, k, wide + 1)
        books = books.copy()
        for p, e in np.argwhere(sums[:, :, wide] > 0):
            books[p, e] = [int(s) // int(sums[p, e, wide]) for s in sums[p, e, :wide]]
    return books


def digest(books: np.ndarray) -> str:
    return sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def compressed(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """id, code (two hex digits a part), error, label_error and codebooks_sha256 of every vector that takes part.

    Numbers become floor(scale * number), saturated to longs. Null and empty vectors and those that hold a null or non-finite
    number take no part, nor do those of another length than most have (of equally frequent lengths the longest). A length that the parts don't
    divide is filled up with zeros, which change no distance. Codebooks start from the vectors of the smallest ids (equal ids by
    vector, null ids last); with fewer vectors than ``entries`` they are as few. Repeated rows count as often as they are there. ``error`` is null where it
    doesn't fit a long; ``label_error``, the sum over an equal label (nulls together), where one of them is null or the sum doesn't fit. An empty table gives an
    empty table. Of columns only the three are read, whatever the names of others.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = rows.sparkSession
    kept = rows.select(column(id_col).alias("id"), column(label_col).alias("label"), column(vec_col).alias("v")).where(finite("v"))
    length = common_length(kept, "v")
    types = {c: rows.schema[name].dataType.simpleString() for c, name in (("id", id_col), ("label", label_col))}
    if not length:
        empty = spark.createDataFrame([], f"id {types['id']}, code string, error long, label_error long, codebooks_sha256 string")
        return empty.withColumnRenamed("id", id_col)
    kept = stored(kept.where(F.size("v") == length).select("id", "label", floored("v", scale).alias("x")))
    first = kept.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()
    start = cut_parts(np.array([r["x"] for r in first], np.int64), parts).transpose(1, 0, 2)
    books = learned(kept, start, rounds, length)
    held = spark.sparkContext.broadcast(books)
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = cut_parts(matrix(batch.column("x"), length), parts)
            found = [nearest(x[:, p], held.value[p])[:2] for p in range(parts)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            errors: Sequence[int] = [sum(int(d[k]) for _, d in found) for k in range(len(x))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())],
                names=["id", "label", "code", "error"],
            )

    coded = stored(kept.mapInArrow(encode, f"id {types['id']}, label {types['label']}, code string, error long"))
    dropped(kept)
    total = F.when(F.count("*") == F.count("error"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long"))
    by_label = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "__label")
    by_label = stored(by_label)
    if by_label.count() <= BROADCAST_LABELS:
        out = coded.join(F.broadcast(by_label), coded["label"].eqNullSafe(by_label["__label"]))
    else:
        dealt = coded.withColumn("__salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        spread = by_label.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = dealt.join(spread, dealt["label"].eqNullSafe(spread["__label"]) & (F.col("__salt") == F.col("__copy")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's code of eight parts, its error and that of its label."""
    return compressed(table(spark, sf_dir, "embeddings"))
