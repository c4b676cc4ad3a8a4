"""Feeds that are fetched page by page, as Python data sources: a task for each account follows that account's cursors.

Landed pages stand for the answers of a service. ``paged_feed`` reads pages ``account=../page=../first=../last=..`` (JSON, ``items`` and the
``next`` page's number), of which the folders' names tell the days, as a service tells them by answering a request for a span of days: conditions on ``day`` and ``account`` are
pushed, and only pages that can hold such days are opened. ``history_feed`` is a stream of landed changes, whose offset is the last history id.

Paths may be local or of any scheme that Arrow's file systems know; driver and executors read them alike.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator, Sequence
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Lets Spark offer a data source in Python the conditions of a query.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: The folder of a null value, as Spark names it.
NULL = "__HIVE_DEFAULT_PARTITION__"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def folders(path: str) -> list[dict[str, str]]:
    """The ``name=value`` folders directly under a path, with where they are."""
    system, root = opened(path)
    found = []
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        name, mark, value = info.base_name.partition("=")
        if mark and info.type == fs.FileType.Directory:
            found.append({name: unquote(value), "path": f"{path.rstrip('/')}/{info.base_name}"})
    return found


def documents(path: str) -> Iterator[Any]:
    """The JSON documents of a folder's files, one a line."""
    system, root = opened(path)
    for info in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
        if info.type == fs.FileType.File and info.size and not info.base_name.startswith(("_", ".")):
            with system.open_input_stream(info.path) as stream:
                yield from (json.loads(line) for line in stream.read().decode().split("\n") if line)


def day_of(text: str) -> dt.date | None:
    return None if text == NULL else dt.date.fromisoformat(text)


class Account(InputPartition):
    def __init__(self, account: str, path: str):
        super().__init__(account)
        self.account, self.path = account, path


class PagedReader(DataSourceReader):
    """Reads accounts' pages; keeps the pushed days, both inclusive, and accounts."""

    def __init__(self, path: str):
        self.path, self.first, self.last, self.accounts = path, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what it can use to open fewer pages. Spark applies every condition to the rows again, as a page holds other days too."""
        day = dt.timedelta(days=1)
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if name == "account" and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.accounts = wanted if self.accounts is None else self.accounts & wanted
            if name == "day" and value is not None:
                low = value if isinstance(f, (EqualTo, GreaterThanOrEqual)) else value + day if isinstance(f, GreaterThan) else None
                high = value if isinstance(f, (EqualTo, LessThanOrEqual)) else value - day if isinstance(f, LessThan) else None
                self.first = max(filter(None, (self.first, low)), default=None)
                self.last = min(filter(None, (self.last, high)), default=None)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Account(a["account"], a["path"]) for a in sorted(folders(self.path), key=lambda a: a["path"]) if self.accounts is None or a["account"] in self.accounts]

    def _wanted(self, first: dt.date | None, last: dt.date | None) -> bool:
        """Whether a page of these days can hold a wanted one; a page without days only where none are asked for."""
        if self.first is None and self.last is None:
            return True
        return first is not None and last is not None and (self.first is None or last >= self.first) and (self.last is None or first <= self.last)

    def fetch(self, path: str) -> Any:
        """One page: the stand-in for a request."""
        return next(documents(path), {})

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """The items of an account's wanted pages, page after page by their cursors, a batch for each."""
        if not isinstance(partition, Account):  # Spark's own partition where no account is there
            return
        known = {}
        for page in folders(partition.path):
            for a in folders(page["path"]):
                for b in folders(a["path"]):
                    known[int(page["page"])] = (day_of(a["first"]), day_of(b["last"]), b["path"])
        cursor = min((k for k, (first, last, _) in known.items() if self._wanted(first, last)), default=None)
        while cursor is not None and cursor in known and self._wanted(*known[cursor][:2]):
            page = self.fetch(known[cursor][2])
            items = page.get("items") or []
            days = [dt.date.fromisoformat(i["day"]) if i.get("day") else None for i in items]
            columns = [pa.array([partition.account] * len(items), pa.string()), pa.array([cursor] * len(items), pa.int32()), pa.array(days, pa.date32()), pa.array([json.dumps(i) for i in items], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["account", "page", "day", "item"])
            cursor = page.get("next")


class PagedFeed(DataSource):
    """Items of landed pages: account, page, day and the item as JSON. Option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "account string, page int, day date, item string"

    def reader(self, schema: Any) -> DataSourceReader:
        return PagedReader(self.options["path"])


class Changes(InputPartition):
    def __init__(self, path: str, after: int, upto: int):
        super().__init__(path)
        self.path, self.after, self.upto = path, after, upto


class HistoryReader(DataSourceStreamReader):
    """Changes after the last known history id. A landed file is a task; files of ids that are known already aren't opened."""

    def __init__(self, path: str):
        self.path = path

    def _files(self) -> list[tuple[int, int, str]]:
        return sorted((int(a["first"]), int(b["last"]), b["path"]) for a in folders(self.path) for b in folders(a["path"]))

    def initialOffset(self) -> dict:
        return {"history": 0}

    def latestOffset(self) -> dict:
        return {"history": max((last for _, last, _ in self._files()), default=0)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, upto = start["history"], end["history"]
        return [Changes(path, after, upto) for first, last, path in self._files() if last > after and first <= upto]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Changes):
            return
        new = [c for page in documents(partition.path) for c in page.get("history") or [] if partition.after < c["id"] <= partition.upto]
        yield pa.RecordBatch.from_arrays([pa.array([c["id"] for c in new], pa.int64()), pa.array([json.dumps(c["message"]) for c in new], pa.string())], names=["history", "message"])


class HistoryFeed(DataSource):
    """Changes as a stream: the history id and the message as JSON. Option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "history_feed"

    def schema(self) -> str:
        return "history long, message string"

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return HistoryReader(self.options["path"])


def paged(spark: SparkSession, path: str) -> DataFrame:
    """The items of landed pages; conditions on ``day`` and ``account`` spare whole pages and accounts."""
    spark.dataSource.register(PagedFeed)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("paged_feed").option("path", path).load()


def history(spark: SparkSession, path: str) -> DataFrame:
    """Landed changes as a stream that goes on after the last history id of its checkpoint. Ids that are no longer landed can't be given: after a gap, all that is there is."""
    spark.dataSource.register(HistoryFeed)
    return spark.readStream.format("history_feed").option("path", path).load()


def land_pages(items: DataFrame, path: str, days: int) -> None:
    """Writes items (account, day and a struct ``item``) as pages of so many days each, a page naming the next of its account. Items without a day share a last page.

    In an item a field ``day`` tells its day. A page's items are gathered in one row: choose ``days`` so that a page stays small.
    """
    number = F.coalesce(F.floor(F.unix_date("day") / days), F.lit(2**30)).cast("int")
    content = F.struct("item.*", F.col("day").cast("string").alias("day"))
    # Missing accounts stay apart from the text "null".
    pages = items.withColumn("page", number).groupBy("account", "page").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.collect_list(content).alias("items"))
    chained = pages.withColumn("next", F.lead("page").over(Window.partitionBy("account").orderBy("page")))
    chained.select("account", "page", "first", "last", F.to_json(F.struct("items", "next")).alias("value")).write.mode("append").partitionBy("account", "page", "first", "last").text(path)


def land_history(changes: DataFrame, path: str, per_file: int = 50) -> None:
    """Writes changes (``id``, from 1, and a struct ``message``) as files of at most so many."""
    files = changes.groupBy(F.floor((F.col("id") - 1) / per_file).alias("file")).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sort_array(F.collect_list(F.struct("id", "message"))).alias("history"))
    files.select("first", "last", F.to_json(F.struct("history")).alias("value")).write.mode("append").partitionBy("first", "last").text(path)
