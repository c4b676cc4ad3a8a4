"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of rotated vectors about their medians make
balanced binary codes. A code is cut into chunks; every vector is entered under each of its chunks, so two
vectors meet if any chunk is equal. What is shuffled to the tables are codes alone: rows of a bucket whose
codes differ in few enough bits are candidates, and only vectors that have any are fetched to be compared by
the cosine of the originals, in double precision. Chunk size follows the number of rows, the number of
chunks follows from it and the wanted chance of meeting at the threshold.

Equal vectors are one node from the start (by a 64-bit hash of label and numbers; two different ones of N are
alike with a probability of about N * N / 2**65). A bucket is cut into blocks of rows, and pairs of blocks
are compared as matrices in separate groups, so that a bucket of a third of all rows is spread over
many tasks; a group puts out a count for each row and a spanning forest of its links, never the pairs.
A pair that meets in several chunks counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import column, dropped, stored, table
from .components import connected_components

#: Rows that the rotation is learned on, at most, in expectation, and numbers that they hold in all; and rows that medians are of.
TRAIN_ROWS, TRAIN_NUMBERS, MEDIAN_ROWS = 20_000, 4_000_000, 4_000
ROUNDS = 30
#: Rows of the medians' sample that are as alike as this count once.
ALIKE = 0.9
#: Vectors that a bucket holds by chance, about, and the chance that vectors at the threshold meet.
BUCKET_ROWS, MEETING = 16, 0.995
#: Most bits of a chunk: with more rows of a label than BUCKET_ROWS * 2**MOST_BITS (3 * 10**10) buckets grow with the table.
MOST_BITS = 31
#: Candidates' codes differ in at most the bits expected at the threshold and so many standard deviations more.
DEVIATIONS = 6.0
BLOCK_ROWS = 512


def learn_rotation(sample: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A projection and thresholds whose signs are the code: principal directions, rotated to fit the signs best, cut at medians.

    Medians are of a sample in which near copies count once: rows that are mostly copies of one vector
    would else have every threshold within their noise. More bits than dimensions take several
    rotations, each from another start.
    """
    _, _, directions = np.linalg.svd(sample, full_matrices=False)
    drawn = np.random.default_rng(seed)
    parts, have = [], 0
    while have < bits:
        own = directions[: bits - have] if len(directions) else np.eye(sample.shape[1])[: bits - have]
        projected = sample @ own.T
        turn = np.linalg.qr(drawn.standard_normal((len(own), len(own))))[0]
        for _ in range(ROUNDS):
            signs = np.where(projected @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ projected)
            turn = (left @ right).T
        parts.append(own.T @ turn)
        have += len(own)
    projection = np.concatenate(parts, axis=1)
    few = sample[:MEDIAN_ROWS]
    once = few[~np.triu(few @ few.T >= ALIKE, 1).any(axis=0)]
    return projection, np.median(once @ projection, axis=0) if len(once) > 1 else np.zeros(bits)


def table_shape(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a chunk, and chunks: so that about BUCKET_ROWS meet by chance and pairs at the threshold meet almost surely."""
    bits = min(MOST_BITS, max(6, ceil(log2(max(2, rows) / BUCKET_ROWS))))
    equal = (1 - acos(threshold) / pi) ** bits
    return bits, max(2, ceil(log(1 - MEETING) / log(1 - equal)))


def most_differing(bits: int, threshold: float) -> int:
    """Bits in which two codes may differ for their vectors to be candidates."""
    p = acos(threshold) / pi
    return ceil(bits * p + DEVIATIONS * sqrt(bits * p * (1 - p)))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, root) that join what the symmetric matrix joins."""
    seen, edges = ~linked.any(axis=1), []
    for start in np.flatnonzero(~seen):
        if seen[start]:
            continue
        seen[start] = True
        edge = np.array([start])
        while len(edge):
            new = np.flatnonzero(linked[edge].any(axis=0) & ~seen)
            seen[new] = True
            edges += [(int(k), int(start)) for k in new]
            edge = new
    return edges


def met_first(chunks: np.ndarray, block: np.ndarray, across: bool, table_no: int) -> np.ndarray:
    """The pairs of rows (a symmetric matrix) that this group has to judge: of two blocks those across them, and only pairs that no earlier table brought together."""
    out = ~np.eye(len(chunks), dtype=bool)
    if across:
        out &= block[:, None] != block[None, :]
    for t in range(table_no):
        out &= chunks[:, t, None] != chunks[None, :, t]
    return out


def candidates(chunks: np.ndarray, block: np.ndarray, across: bool, table_no: int, most: int) -> np.ndarray:
    """Which rows of a group have another whose code differs in few enough bits."""
    differ = np.zeros((len(chunks), len(chunks)), np.int16)
    for t in range(chunks.shape[1]):
        differ += np.bitwise_count(chunks[:, t, None] ^ chunks[None, :, t])
    return (met_first(chunks, block, across, table_no) & (differ <= most)).any(axis=1)


def compare(node: np.ndarray, unit: np.ndarray, chunks: np.ndarray, copies: np.ndarray, block: np.ndarray, across: bool, table_no: int, threshold: float):
    """What one group, of a block or across two, adds: links of each row (copies counted), and edges."""
    linked = (unit @ unit.T >= threshold) & met_first(chunks, block, across, table_no)
    if not linked.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    counts = linked @ copies
    own = np.flatnonzero(counts)
    return node[own], counts[own], [(int(node[a]), int(node[b])) for a, b in forest(linked)]


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Sorted rows in tables of whole groups, with where each group starts and ends; a group may run on into the next batches."""
    rest: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part])
        codes = np.stack([part[k].to_numpy() for k in keys])
        edges = np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1
        if len(edges):
            yield part.slice(0, int(edges[-1])), np.concatenate([[0], edges[:-1]]), edges
            rest = part.slice(int(edges[-1]))
        else:
            rest = part
    if rest is not None and rest.num_rows:
        yield rest, np.array([0]), np.array([rest.num_rows])


def link_nodes(nodes: DataFrame, threshold: float, seed: int = 7) -> DataFrame:
    """Rows (node, n, other): links of the nodes, to be summed, and edges of a spanning forest where other isn't null.

    ``nodes`` has node, label, embedding (arrays of finite numbers, not all zero) and copies.
    """
    spark = nodes.sparkSession
    sizes = nodes.groupBy("label", F.size("embedding").alias("dim")).count()
    shape = sizes.groupBy("dim").agg(F.max("count").alias("rows"), F.sum("count").alias("all")).orderBy("dim").collect()
    out = None
    for s in shape:
        dim, bits_chunks = s["dim"], table_shape(s["rows"], threshold)
        own = nodes.where(F.size("embedding") == dim)
        part = _link_one(spark, own, dim, s["all"], *bits_chunks, threshold, seed)
        out = part if out is None else out.unionByName(part)
    return out


def _link_one(spark: SparkSession, nodes: DataFrame, dim: int, rows: int, bits: int, n_chunks: int, threshold: float, seed: int) -> DataFrame:
    share = min(1.0, TRAIN_ROWS / rows, TRAIN_NUMBERS / (rows * dim))
    chosen = F.pmod(F.xxhash64("node", F.lit("rotation")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = nodes.where(chosen < share).select("embedding").toArrow()["embedding"].combine_chunks()
    flat = np.asarray(sample.flatten(), np.float64).reshape(-1, dim) if len(sample) else np.eye(dim)
    learned = learn_rotation(flat / np.linalg.norm(flat, axis=1, keepdims=True), bits * n_chunks, seed)
    held = spark.sparkContext.broadcast(learned)
    powers = 1 << np.arange(bits, dtype=np.int64)
    most = most_differing(bits * n_chunks, threshold)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, cuts = held.value
        for batch in batches:
            x = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(-1, dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            signs = (x @ projection >= cuts).reshape(len(x), n_chunks, bits)
            chunks = pa.FixedSizeListArray.from_arrays(pa.array((signs @ powers).astype(np.int32).ravel()), n_chunks).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), chunks], names=["node", "label", "chunks"])

    coded = stored(nodes.select("node", "label", "embedding").mapInArrow(encode, "node long, label long, chunks array<int>"))
    entered = coded.select("node", "label", F.posexplode("chunks").alias("table_no", "chunk"))
    buckets = entered.groupBy("label", "table_no", "chunk").count().where("count > 1")
    buckets = buckets.withColumn("blocks", F.ceil(F.col("count") / BLOCK_ROWS).cast("int")).drop("count")
    rows_ = coded.select("*", F.posexplode("chunks").alias("table_no", "chunk")).join(buckets, ["label", "table_no", "chunk"])
    rows_ = rows_.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A block meets itself and every other block of its bucket, each pair of blocks in a group of its own.
    rows_ = rows_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["label", "table_no", "chunk", "one", "two"]
    rows_ = rows_.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("blocks", "other")
    placed = rows_.select(*keys, "block", "node", "chunks").repartition(*keys).sortWithinPartitions(*keys)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts, ends in grouped(batches, keys):
            chunks = np.asarray(part["chunks"].combine_chunks().flatten()).reshape(-1, n_chunks)
            block, table_no = part["block"].to_numpy(), part["table_no"].to_numpy()
            across = part["one"].to_numpy() != part["two"].to_numpy()
            needed = np.zeros(part.num_rows, bool)
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    needed[a:b] = candidates(chunks[a:b], block[a:b], bool(across[a]), int(table_no[a]), most)
            yield from part.filter(pa.array(needed)).combine_chunks().to_batches()

    schema = "label long, table_no int, chunk int, one int, two int, block int, node long, chunks array<int>"
    wanted = stored(placed.mapInArrow(near, schema))
    fetched = wanted.join(nodes.select("node", "copies", "embedding"), "node")
    met = fetched.select(*keys, "block", "node", "copies", "embedding", "chunks").repartition(*keys).sortWithinPartitions(*keys)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts, ends in grouped(batches, keys):
            x = np.asarray(part["embedding"].combine_chunks().flatten(), np.float64).reshape(-1, dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            chunks = np.asarray(part["chunks"].combine_chunks().flatten()).reshape(-1, n_chunks)
            node, copies, block, table_no = (part[c].to_numpy() for c in ("node", "copies", "block", "table_no"))
            across = part["one"].to_numpy() != part["two"].to_numpy()
            out_node, out_n, edges = [], [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    found, counts, more = compare(node[a:b], x[a:b], chunks[a:b], copies[a:b], block[a:b], bool(across[a]), int(table_no[a]), threshold)
                    out_node.append(found)
                    out_n.append(counts)
                    edges += more
            node_ = np.concatenate([*out_node, np.array([a for a, _ in edges], np.int64)]) if out_node else np.zeros(0, np.int64)
            n_ = np.concatenate([*out_n, np.zeros(len(edges), np.int64)]) if out_n else np.zeros(0, np.int64)
            other = [None] * (len(node_) - len(edges)) + [b for _, b in edges]
            yield pa.RecordBatch.from_arrays([pa.array(node_, pa.int64()), pa.array(n_, pa.int64()), pa.array(other, pa.int64())], names=["node", "n", "other"])

    found = stored(met.mapInArrow(link, "node long, n long, other long"))
    dropped(coded, wanted)
    return found


def near_duplicates(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id and kept of every row of ``rows``.

    Rows link when their labels are equal and not null, their vectors have as many numbers and the
    cosine is at least ``threshold``. Null, empty and zero vectors and those with a null or
    non-finite number link with nothing: 0 links, their own id as component. Equal vectors always
    link, repeated rows too. ``component_id`` is the smallest non-null id that links reach;
    ``kept`` says that it is the row's own. No pair below the threshold links; of those above, a pair
    is missed only if no chunk of its codes is equal. An empty table gives an empty table.
    """
    kind = "array<float>" if rows.schema[vec_col].dataType == ArrayType(FloatType()) else "array<double>"
    rows = rows.select(column(id_col).alias("__id"), column(label_col).cast("long").alias("label"), column(vec_col).cast(kind).alias("embedding"))
    clean = F.size("embedding") > 0
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & clean & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    embedding = F.when(valid, F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast(kind[6:-1])).otherwise(x)))  # -0 is 0
    rows = rows.withColumn("embedding", embedding).withColumn("node", F.when(valid, F.xxhash64("label", embedding)))
    rows = stored(rows)
    valid_rows = rows.where("node IS NOT NULL")
    nodes = stored(
        valid_rows.groupBy("node").agg(F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("__id").alias("least"))
    )
    found = link_nodes(nodes, threshold)
    own = nodes.select("node", "copies", "least")
    if found is None:
        merged = own.withColumn("n_links", F.col("copies") - 1).withColumn("component_id", F.col("least"))
    else:
        sums = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("n"))
        components = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
        merged = own.join(sums, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = merged.groupBy("component").agg(F.min("least").alias("component_id"))
        merged = merged.join(least, "component").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n", F.lit(0)))
    merged = stored(merged.select("node", "n_links", "component_id"))
    dropped(nodes)
    full = valid_rows.select("__id", "node").join(merged, "node").select("__id", "n_links", "component_id")
    lone = rows.where("node IS NULL").select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"))
    out = full.unionByName(lone)
    return out.withColumn("kept", F.col("__id").eqNullSafe(F.col("component_id"))).withColumnRenamed("__id", id_col)


def op9_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's links, the smallest id that they reach, and whether it is its own."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
