"""Streams that keep state by key: sliding limits and jobs that run too long.

Both wait for event time: a row is decided when the watermark has passed it, so that the order in which files arrive
within the allowed lateness doesn't change a result. Rows later than that are dropped by Spark, which counts them in the
progress (``numRowsDroppedByWatermark``). State is dropped by event-time timers too, as Spark's own time to live goes by the clock: a key holds the
rows of one window and the lateness, and nothing when it has been quiet for so long. Rows without a key only move time on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decided_at(micros: int) -> int:
    """The watermark in milliseconds from which on no row of this time can come any more."""
    return micros // 1000 + 1


class SlidingLimit(StatefulProcessor):
    """Gives each row how many rows of its key there were in the window up to and with it, rows of its own microsecond counted, and whether they are at most ``most``."""

    def __init__(self, span: int, most: int, key: str, id_type: str):
        self.span, self.most, self.key, self.id_type = span, most, key, id_type

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, id {self.id_type}")
        self.seen = handle.getListState("seen", "at long, n long")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, ms: int) -> None:
        now = self.timer.get()
        if now is None or ms < now[0]:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in zip(part["at"].tolist(), part["id"].tolist(), strict=True)]
        if not pd.isna(key[0]):
            self.waiting.appendList(new)
            self._wake(decided_at(min(at for at, _ in new)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in waiting if decided_at(r[0]) <= watermark]
        seen = dict(tuple(r) for r in self.seen.get())
        for at, _ in ready:
            seen[at] = seen.get(at, 0) + 1
        times, recent, low, total = sorted(seen), {}, 0, 0
        for at in times:
            total += seen[at]
            while times[low] < at - self.span:
                total -= seen[times[low]]
                low += 1
            recent[at] = total
        rest = waiting[len(ready) :]
        kept = [(at, seen[at]) for at in times if decided_at(at + self.span) > watermark]
        for state, left in ((self.waiting, rest), (self.seen, kept)):
            state.put(left) if left else state.clear()
        if rest or kept:
            self._wake(decided_at(rest[0][0]) if rest else decided_at(kept[-1][0] + self.span))
        if ready:
            counts = [recent[at] for at, _ in ready]
            yield pd.DataFrame({self.key: key[0], "id": [i for _, i in ready], "recent": counts, "allowed": [n <= self.most for n in counts]})


class OverdueJobs(StatefulProcessor):
    """Gives each active row a ``failed`` row when the job has had no other row for longer than the limit."""

    def __init__(self, limit: int, key: str, id_type: str):
        self.limit, self.key, self.id_type = limit, key, id_type

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.history = handle.getListState("history", f"at long, id {self.id_type}, active boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in zip(part["at"].tolist(), part["id"].tolist(), part["active"].tolist(), strict=True)]
        if not pd.isna(key[0]):
            self.history.appendList(new)
            for ms in {decided_at(at + self.limit) for at, _, _ in new}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(tuple(r) for r in self.history.get())
        failed = []
        for k, (at, row, active) in enumerate(rows):
            alone = k + 1 == len(rows) or rows[k + 1][0] > at + self.limit
            if active and alone and decided_at(at + self.limit) == ms:
                failed.append((row, at + self.limit))
        left = [r for r in rows if decided_at(r[0] + self.limit) > ms]
        self.history.put(left) if left else self.history.clear()
        if failed:
            yield pd.DataFrame({self.key: key[0], "id": [i for i, _ in failed], "status": "failed", "at": pd.to_datetime([at for _, at in failed], unit="us")})


def _keyed(stream: DataFrame, key: str, id_col: str, ts: str, late: str, **more: Column) -> DataFrame:
    """What a processor gets: the key, the row's id and its time in microseconds, under a watermark."""
    # Spark keeps this state in RocksDB only; other streams of the session run with it as well.
    stream.sparkSession.conf.set(STORE, ROCKS)
    columns = {"id": F.col(id_col), "at": F.unix_micros(F.col(ts).cast("timestamp")), **more}
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).where(F.col(ts).isNotNull()).select(key, ts, *[c.alias(n) for n, c in columns.items()])


def _types(stream: DataFrame, key: str, id_col: str) -> tuple[str, str]:
    return stream.schema[key].dataType.simpleString(), stream.schema[id_col].dataType.simpleString()


def limited(stream: DataFrame, key: str, id_col: str, ts: str, seconds: int, most: int, late: str) -> DataFrame:
    """key, id, recent and allowed of each row of the stream, as ``ingest.recent_counts`` gives them of a table.

    Rows without a time are left out, those without a key only move the watermark. A key's state is the times (with counts) of one window and the rows that wait for the watermark.
    """
    kinds = _types(stream, key, id_col)
    out = f"{key} {kinds[0]}, id {kinds[1]}, recent long, allowed boolean"
    return _keyed(stream, key, id_col, ts, late).groupBy(key).transformWithStateInPandas(SlidingLimit(seconds * 1_000_000, most, key, kinds[1]), out, "Append", "EventTime")


def overdue(stream: DataFrame, key: str, id_col: str, ts: str, active: Column, minutes: int, late: str) -> DataFrame:
    """key, id, status ``failed`` and its time, for each active row after which its job has no row for longer than so many minutes.

    Given once, when the watermark has passed the row's time by that much. Rows of a job follow each other by time, then id.
    """
    kinds = _types(stream, key, id_col)
    out = f"{key} {kinds[0]}, id {kinds[1]}, status string, at timestamp"
    keyed = _keyed(stream, key, id_col, ts, late, active=F.coalesce(active, F.lit(False)))
    return keyed.groupBy(key).transformWithStateInPandas(OverdueJobs(minutes * 60_000_000, key, kinds[1]), out, "Append", "EventTime")


def drained(stream: DataFrame, target: str, checkpoint: str, progress: Callable[[dict], None] | None = None) -> None:
    """Writes what a stream gives, until nothing more is available, as Parquet files under ``target``, each row once; may be run again with more input."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    for p in query.recentProgress:
        if progress is not None:
            progress(p)


def heartbeat(spark: SparkSession, path: str, schema: Any, ts: str, at: Any) -> None:
    """Lands a file of one row that holds a time and nothing else: the word that time has come so far, by which waiting rows are decided."""
    row = spark.createDataFrame([(at,)], "at timestamp").select(*[F.col("at").cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    row.coalesce(1).write.mode("append").parquet(path)
