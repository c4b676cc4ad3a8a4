"""Feeds read page by page: whole, with pushed days and accounts, and changes as a stream with a restart."""

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan

from pennyflow.sources import paged

DAY = dt.date(2024, 1, 1)


def land(spark, path):
    rows = [(f"a{k % 3}", DAY + dt.timedelta(days=k), f"t{k}") for k in range(60)] + [("a0", None, "t60"), ("a b/c", DAY, "é")]
    items = spark.createDataFrame(rows, "account string, day date, id string").select("account", "day", F.struct("id").alias("item"))
    paged.land_pages(items, path, 10)
    return rows


def key(rows):
    return sorted(((a, d, i) for a, d, i in rows), key=str)


def test_pages_come_back_whole(spark, tmp_path):
    path = f"{tmp_path}/pages"
    rows = land(spark, path)
    got = paged.paged(spark, path)
    assert key((r["account"], r["day"], json.loads(r["item"])["id"]) for r in got.collect()) == key(rows)
    window = got.where("day >= DATE '2024-01-15' AND day < DATE '2024-01-20' AND account IN ('a1', 'a2')")
    assert key((r["account"], r["day"], json.loads(r["item"])["id"]) for r in window.collect()) == key(r for r in rows if r[1] and dt.date(2024, 1, 15) <= r[1] < dt.date(2024, 1, 20) and r[0] in ("a1", "a2"))
    assert paged.paged(spark, f"{tmp_path}/none").count() == 0
    # What isn't asked for isn't opened: pages that can't be read do no harm.
    for p in (tmp_path / "pages" / "account=a0").rglob("part-*"):
        p.write_bytes(b"\xff broken")
    assert window.count() == 3 and got.where("account = 'a1' AND day > DATE '2024-02-25'").count() == 1


def reads(path, filters):
    """How many pages are opened under the filters, and how many items they hold."""
    reader, opened = paged.PagedReader(path), []
    list(reader.pushFilters(filters))
    fetch = reader.fetch
    reader.fetch = lambda p: opened.append(p) or fetch(p)
    items = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    return len(opened), items


def test_pushed_days_open_fewer_pages(spark, tmp_path):
    path = f"{tmp_path}/pages"
    land(spark, path)
    day = ("day",)
    counts = {}
    for name, filters in {
        "all": [], "from": [GreaterThanOrEqual(day, dt.date(2024, 2, 10))], "one": [EqualTo(day, dt.date(2024, 1, 15))], "account": [EqualTo(("account",), "a1")],
        "between": [GreaterThan(day, dt.date(2024, 1, 9)), LessThan(day, dt.date(2024, 1, 20))], "none": [GreaterThan(day, dt.date(2025, 1, 1))],
    }.items():
        counts[name] = reads(path, filters)
    assert counts["all"][1] == 62 and counts["none"] == (0, 0)
    assert counts["account"][1] == 20 and counts["account"][0] < counts["all"][0] / 2
    assert counts["one"][0] == 3 and counts["from"][0] < counts["all"][0] / 2 and counts["between"][0] < counts["all"][0] / 2


def test_history_goes_on_after_a_restart(spark, tmp_path):
    changes = lambda a, b: spark.range(a, b).select("id", F.struct(F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id")).alias("message"))
    path, out, checkpoint = f"{tmp_path}/history", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    seen = []
    for a, b in ((1, 131), (131, 140), (140, 140), (140, 300)):
        if b > a:
            paged.land_history(changes(a, b), path)
        stream = paged.history(spark, path)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        seen.append(spark.read.parquet(out).count())
    got = spark.read.parquet(out).orderBy("history").collect()
    assert seen == [130, 139, 139, 299] and [r["history"] for r in got] == list(range(1, 300)) and json.loads(got[4]["message"]) == {"message_id": "m5"}


def test_known_files_are_not_opened(spark, tmp_path):
    changes = spark.range(1, 101).select("id", F.struct("id").alias("message"))
    paged.land_history(changes, f"{tmp_path}/h", 10)
    reader = paged.HistoryReader(f"{tmp_path}/h")
    assert reader.latestOffset() == {"history": 100} and len(reader.partitions({"history": 0}, {"history": 100})) == 10
    parts = reader.partitions({"history": 85}, {"history": 100})
    assert len(parts) == 2 and sum(b.num_rows for p in parts for b in reader.read(p)) == 15
