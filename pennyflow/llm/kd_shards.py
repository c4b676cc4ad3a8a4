"""Sharding by a k-d tree over document metadata.

All rows start in one node that has to hold every shard. A node of several shards is split along the
dimension in which its rows spread widest, at the weighted quantile that gives each side the bytes of
its shards (the weighted median where the shards halve), until each leaf is one shard of the target
bytes. Within equal values of a dimension rows are in the order of their text's checksum and then of
a hash of their id, so that a value held by a third of all rows is split like any other, and equal
texts with equal metadata lie side by side.

The tree is built level by level, all nodes of a level together. Medians are found by histograms: each
pass sums bytes into bins for each node and narrows the range to the bin with the quantile, in Spark, so
that nodes and bins stay tables however many shards there are; the driver learns only whether a node
is left. Each level's splits are joined to the narrow rows, which carry their node on.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, dropped, stored, table

#: Values of a dimension run from 0 to 65,535; 31 bits of checksum and 16 of a hash of the id follow.
DIM_VALUES, TIE_BITS = 65_536, 47
#: Bins of a pass, over all nodes of a level, and at least for each.
BINS, LEAST_BINS = 1 << 17, 256
#: Tables of nodes up to this size are broadcast (under 100 bytes a row); larger ones are joined by a shuffle.
BROADCAST_NODES = 100_000
#: A cut may miss its quantile by this share of one shard's bytes, or by one row.
TOLERANCE = 0.001
#: Rows numbered by one task's window group.
CELL_ROWS = 2_000


def category_value(c: Column) -> Column:
    """A category's place on its axis, by hash; null comes first."""
    return F.when(c.isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(c), F.lit(DIM_VALUES - 1))).cast("long")


def size_value(size: Column) -> Column:
    """A size's place on its axis: its logarithm."""
    return F.least(F.lit(DIM_VALUES - 1), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 1024)).cast("long")


def tie_value(text_crc32: Column, row_id: Column) -> Column:
    own = F.pmod(F.xxhash64(row_id), F.lit(1 << 16))
    return F.shiftright(text_crc32, 1) * F.lit(1 << 16) + own


def _few(nodes: DataFrame, n_shards: int) -> DataFrame:
    """The table of nodes, at most as many as shards, to be broadcast if these are few."""
    return F.broadcast(nodes) if n_shards <= BROADCAST_NODES else nodes


def _key(dims: Sequence[str], at: Column) -> Column:
    """A row's key in the dimension of that number: its value there, and its tie behind it."""
    return F.element_at(F.array(*[F.col(d) for d in dims]), at + 1) * F.lit(1 << TIE_BITS) + F.col("tie")


def _cuts(rows: DataFrame, jobs: DataFrame, dims: Sequence[str], bins: int, slack: float, n_shards: int) -> DataFrame:
    """node, dim and cut of each job (node, dim, lo, hi, want): the key below which about ``want`` bytes lie."""
    jobs = stored(jobs.withColumns({"left": F.lit(0.0), "cut": F.lit(None).cast("long")}))
    for _ in range(64):
        open_jobs = jobs.where("cut IS NULL").withColumn("step", F.expr(f"(hi - lo) DIV {bins} + 1"))
        held = rows.join(_few(open_jobs, n_shards), "node").withColumn("key", _key(dims, F.col("dim"))).where("key >= lo AND key <= hi")
        found = held.groupBy("node", F.expr("(key - lo) DIV step").alias("bin")).agg(F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        in_order = Window.partitionBy("node").orderBy("bin")
        found = found.withColumn("last", F.lead("bin").over(in_order).isNull()).withColumn("sum", F.sum("size").over(in_order))
        found = found.join(_few(open_jobs.select("node", "dim", "left", "want"), n_shards), "node").withColumn("after", F.col("left") + F.col("sum"))
        best = found.where("after >= want OR last").groupBy("node").agg(F.min_by(F.struct("dim", "want", "lo", "hi", "size", "after"), "bin").alias("b")).select("node", "b.*")
        before = F.col("after") - F.col("size")
        cut = F.when((F.col("lo") == F.col("hi")) | (F.col("size") <= slack), F.when(F.col("after") - F.col("want") <= F.col("want") - before, F.col("hi") + 1).otherwise(F.col("lo")))
        narrowed = best.select("node", "dim", "lo", "hi", "want", before.alias("left"), cut.alias("cut"))
        last, jobs = jobs, stored(jobs.where("cut IS NOT NULL").unionByName(narrowed))
        dropped(last)
        if jobs.where("cut IS NULL").isEmpty():
            return jobs.select("node", "dim", "cut")
    raise RuntimeError("quantiles have not settled")


def plan_shards(rows: DataFrame, dims: Sequence[str], n_shards: int) -> DataFrame:
    """A stored table of ``rows``, which have a long ``size``, a ``tie`` and the named dimensions, with their ``shard``."""
    ends = rows.agg(F.sum("size").alias("size"), *[f(d).alias(f"{name}_{d}") for d in dims for f, name in ((F.min, "lo"), (F.max, "hi"))]).first()
    spans = [max(1, (ends[f"hi_{d}"] or 0) - (ends[f"lo_{d}"] or 0)) for d in dims]
    slack = TOLERANCE * (ends["size"] or 0) / n_shards
    placed = stored(rows.withColumns({"node": F.lit(1).cast("long"), "first": F.lit(0).cast("long"), "n": F.lit(n_shards).cast("long")}))
    for level in range((n_shards - 1).bit_length()):
        known = placed.where("n > 1").groupBy("node", "n").agg(
            F.sum("size").alias("size"), *[((F.max(d) - F.min(d)) / span).alias(f"width{k}") for k, (d, span) in enumerate(zip(dims, spans, strict=True))],
            *[f(_key(dims, F.lit(k))).alias(f"{name}{k}") for k in range(len(dims)) for f, name in ((F.min, "from"), (F.max, "to"))],
        )
        widths = F.array(*[F.col(f"width{k}") for k in range(len(dims))])
        known = known.withColumn("dim", (F.array_position(widths, F.array_max(widths)) - 1).cast("int"))
        end = lambda name: F.element_at(F.array(*[F.col(f"{name}{k}") for k in range(len(dims))]), F.col("dim") + 1)
        want = F.col("size") * F.floor(F.col("n") / 2) / F.col("n")
        jobs = known.select("node", "dim", end("from").alias("lo"), end("to").alias("hi"), want.cast("double").alias("want"))
        cuts = _cuts(placed, jobs, dims, max(LEAST_BINS, BINS >> level), slack, n_shards)
        split = placed.join(_few(cuts, n_shards), "node", "left").withColumn("right", (_key(dims, F.col("dim")) >= F.col("cut")).cast("long"))
        half = F.floor(F.col("n") / 2)
        moved = F.col("cut").isNotNull()
        before, placed = placed, stored(split.select(
            *rows.columns, F.when(moved, F.col("node") * 2 + F.col("right")).otherwise(F.col("node")).alias("node"), F.when(moved, F.col("first") + half * F.col("right")).otherwise(F.col("first")).alias("first"),
            F.when(moved, F.when(F.col("right") == 1, F.col("n") - half).otherwise(half)).otherwise(F.col("n")).alias("n"),
        ))
        dropped(before, cuts)
    return placed.withColumn("shard", F.col("first").cast("int")).drop("node", "first", "n")


def numbered(rows: DataFrame, shard_col: str, order: Sequence[str], spread: Column, n_shards: int) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2, ... within each shard, without sorting a shard in one task.

    A shard's rows are dealt into cells by ``spread``; cells are numbered by themselves, after the
    rows of the cells before them.
    """
    cells = rows.groupBy(shard_col).agg(F.ceil(F.count("*") / CELL_ROWS).alias("_cells"))
    rows = rows.join(_few(cells, n_shards), shard_col).withColumn("_cell", F.pmod(spread, F.col("_cells"))).drop("_cells")
    sums = rows.groupBy(shard_col, "_cell").count()
    before = Window.partitionBy(shard_col).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy(shard_col, "_cell").orderBy(*order)
    rows = rows.withColumn("_at", F.row_number().over(own)).join(sums, [shard_col, "_cell"])
    return rows.withColumn("slot", (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_cell", "_before", "_at")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: Sequence[str] = ("lang", "source")) -> DataFrame:
    """A narrow row for each document: id, size (UTF-8 bytes of the text, plus 8), text_crc32, tie and dimensions ``d0``, ``d1``, ..."""
    raw = F.coalesce(F.encode(column(text_col), "UTF-8"), F.lit(b""))
    size, crc = (F.octet_length(raw) + 8).cast("long"), F.crc32(raw)
    dims = [size_value(size), *[category_value(column(c)) for c in categories]]
    return docs.select(column(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"), tie_value(crc, column(id_col)).alias("tie"), *[d.alias(f"d{k}") for k, d in enumerate(dims)])


def kd_shards(
    docs: DataFrame,
    n_shards: int = 24,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: Sequence[str] = ("lang", "source"),
) -> DataFrame:
    """id, size, text_crc32, shard and slot of every row of ``docs``; shards' bytes are near equal.

    With ``target_bytes``, there are as many shards as give each about so many bytes. Dimensions are
    the size and the named categories. A null text counts as empty, of size 8; null categories and
    null ids count as a value. A text of any length is one row of one shard, which it may overfill. Rows
    equal in id, text and metadata stay in one shard and are numbered one after the other. An empty
    table gives an empty table; other columns are not looked at, whatever their names.
    """
    rows = stored(measured(docs, id_col, text_col, categories))
    dims = [f"d{k}" for k in range(1 + len(categories))]
    if target_bytes is not None:
        n_shards = max(1, ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    placed = plan_shards(rows, dims, n_shards).select("id", "size", "text_crc32", "shard")
    dropped(rows)
    out = numbered(placed, "shard", ["id", "text_crc32"], F.xxhash64("id", "text_crc32"), n_shards)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's size, checksum, shard and slot; by the law ``bytes`` no shard is grown."""
    out = kd_shards(table(spark, sf_dir, "documents"))
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
