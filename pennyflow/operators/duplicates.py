"""Near-duplicate rows of a key in time: the first of alike rows is kept, and what is kept decides about the rows after it.

A key's rows are swept in slices of time, and each row of a slice is met once, in order, by a task that holds only the kept rows of the last minutes. Hours that follow each other make one slice as long as
their rows are few. A slice starts with what the slice before it handed over: its kept rows of the last minutes. All slices are swept at once with nothing handed over; then those again that a
hand-over reaches. Where those hand over something else than before, the slices behind them are swept from then on only when those before them wait no more; the rows are those of one sweep in order.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, stored

#: Hours that aren't parted; much longer than rows may be apart. And a slice's rows, which a task meets one after the other: it ends with the hours that reach so many.
SLICE_HOURS, SLICE_ROWS = 6, 250_000


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    """The matching-blocks ratio of two texts."""
    return SequenceMatcher(None, a, b).ratio()


@lru_cache(maxsize=10_000)
def letters(text: str) -> Counter:
    return Counter(text)


@lru_cache(maxsize=100_000)
def alike(a: str, b: str, similar: float) -> bool:
    """Whether the ratio is above ``similar``: lengths, then letters in common bound it from above, and only where they don't settle it is it computed."""
    if a == b:
        return similar < 1.0
    total = len(a) + len(b)
    if 2.0 * min(len(a), len(b)) <= similar * total:
        return False
    if 2.0 * (letters(a) & letters(b)).total() <= similar * total:
        return False
    return ratio(a, b) > similar


#: Rows of a sweep: pairs (original, id) and, with a null original, kept rows near the slice's end.
SWEPT = "key string, slice long, original long, id long, at long, items string"


def _swept(rows: DataFrame, span: int, similar: float) -> DataFrame:
    # Dealt by a hash of its own: a shuffle by the columns themselves is left out over a union of joins by them, whose sides may then be dealt differently.
    # A number of parts is given, as few slices would else be put into one task by their bytes.
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    placed = rows.repartition(parts, F.xxhash64("key", "slice")).sortWithinPartitions("key", "slice", F.desc("seed"), "at", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, kept = None, deque()
        for batch in batches:
            if not batch.num_rows:
                continue
            key, number, at, ids, items, seed = (batch.column(c) for c in ("key", "slice", "at", "id", "items", "seed"))
            begins = [(key[0].as_py(), number[0].as_py()) != of, *pc.or_(pc.not_equal(key[1:], key[:-1]), pc.not_equal(number[1:], number[:-1])).to_pylist()]
            of = key[-1].as_py(), number[-1].as_py()
            originals = []
            for begin, t, row, text, known in zip(begins, at.to_pylist(), ids.to_pylist(), items.to_pylist(), seed.to_pylist(), strict=True):
                if begin:
                    kept.clear()
                while kept and t - kept[0][0] > span:
                    kept.popleft()
                # Seeds were kept before and aren't told again.
                original = None if known else next((k for _, k, other in kept if alike(other, text, similar)), None)
                if original is None:
                    kept.append((t, row, text))
                originals.append(original)
            original = pa.array(originals, pa.int64())
            pairs, ends = original.is_valid(), pc.greater_equal(at, pc.subtract(batch.column("ends"), span))
            told = pa.RecordBatch.from_arrays([key, number, original, ids, at, pc.if_else(pairs, pa.scalar(None, pa.string()), items.cast(pa.string()))], names=["key", "slice", "original", "id", "at", "items"])
            yield told.filter(pc.or_(pairs, pc.and_(ends, pc.invert(seed))))

    return placed.select("key", "slice", "ends", "at", "id", "items", "seed").mapInArrow(run, SWEPT)


def _sliced(rows: DataFrame, slice_span: int, slice_rows: int) -> DataFrame:
    """``rows`` (key, at) with ``slice``, counted from 0 in each key, and the instant at which it ``ends``: hours that follow each other, up to those that reach ``slice_rows`` rows."""
    hours = F.floor(F.col("at") / slice_span)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("hours").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy("key", hours.alias("hours")).agg(F.count("*").alias("n")).withColumn("filled", F.floor(before / slice_rows))
    slices = counts.groupBy("key", "filled").agg(F.max("hours").alias("most"), F.collect_list("hours").alias("each"))
    slices = slices.withColumn("slice", F.row_number().over(Window.partitionBy("key").orderBy("filled")).cast("long") - 1)
    of = slices.select("key", "slice", ((F.col("most") + 1) * slice_span).alias("ends"), F.explode("each").alias("hours"))
    return rows.withColumn("hours", hours).join(of, ["key", "hours"]).drop("hours")


def duplicates(
    rows: DataFrame, keys: Sequence[str], id_col: str, ts_col: str, items_col: str, minutes: int = 5, similar: float = 0.8, slice_hours: float = SLICE_HOURS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """original and duplicate ids: rows of equal keys within so many minutes of a kept row whose items' text is more alike than ``similar``.

    In the order of time (then id) the first of such rows is kept and the others are its duplicates, which have none of their own. Null keys are equal to each other.
    Rows without a time or items are no duplicates. Ids are whole numbers; of equal ids each row counts. Hours that reach ``slice_rows`` rows of a key are one slice, which one task sweeps; a key whose kept rows
    depend on each other without a pause takes a round for each of its slices.
    """
    span, slice_span = minutes * 60_000_000, int(slice_hours * 3_600_000_000)
    if slice_span < span:
        raise ValueError("a slice has to be at least as long as rows may be apart")
    at = F.unix_micros(F.col(ts_col).cast("timestamp"))
    base = rows.select(F.to_json(F.struct(*keys)).alias("key"), F.col(id_col).cast("long").alias("id"), at.alias("at"), F.col(items_col).alias("items")).where("at IS NOT NULL AND items IS NOT NULL AND items <> ''")
    base = stored(_sliced(base, slice_span, slice_rows).select("key", "slice", "ends", "at", "id", "items", F.lit(False).alias("seed")))
    # Every sweep of a slice, by rounds; the last one counts.
    rounds = [stored(_swept(base, span, similar))]
    handed = lambda df: df.where("original IS NULL").select("key", "slice", "id", "at", "items")
    following = (F.col("slice") + 1).alias("slice")
    ends, starts = handed(rounds[0]), cut(base.groupBy("key", "slice").agg(F.min("at").alias("first"), F.first("ends").alias("ends"), F.lit(0).alias("round")))
    # Slices that rows near the end of the one before reach, by their first rows.
    waiting = cut(ends.select("key", following, "at").join(starts, ["key", "slice"]).where(F.col("first") - F.col("at") <= span).select("key", "slice").distinct())
    last = [starts.select("key", "slice", "round")]
    while not waiting.isEmpty():
        # First all of them, as what is handed over mostly comes out the same whatever came before; then those whose predecessor waits no more. They are few: a key has one for each ``slice_rows`` rows.
        now = waiting if len(rounds) == 1 else cut(waiting.join(F.broadcast(waiting.select("key", following)), ["key", "slice"], "left_anti"))
        own = base.join(F.broadcast(now), ["key", "slice"], "left_semi")
        seeds = ends.select("key", following, "at", "id", "items", F.lit(True).alias("seed")).join(F.broadcast(now), ["key", "slice"], "left_semi").join(starts.select("key", "slice", "ends"), ["key", "slice"])
        again = stored(_swept(own.unionByName(seeds), span, similar))
        before = ends.join(F.broadcast(now), ["key", "slice"], "left_semi").select("key", "slice", "id", "at")
        after = handed(again).select(before.columns)
        differ = after.exceptAll(before).unionByName(before.exceptAll(after)).select("key", following).distinct().join(starts, ["key", "slice"], "left_semi")
        waiting = cut(waiting.join(F.broadcast(now), ["key", "slice"], "left_anti").unionByName(differ).distinct())
        ends = cut(ends.join(F.broadcast(now), ["key", "slice"], "left_anti").unionByName(handed(again)))
        last.append(now.withColumn("round", F.lit(len(rounds))))
        rounds.append(again)
    pairs = reduce(DataFrame.unionByName, [df.where("original IS NOT NULL").withColumn("round", F.lit(k)) for k, df in enumerate(rounds)])
    if len(rounds) > 1:
        pairs = pairs.join(reduce(DataFrame.unionByName, last).groupBy("key", "slice").agg(F.max("round").alias("round")), ["key", "slice", "round"], "left_semi")
    return pairs.select("original", F.col("id").alias("duplicate"))
