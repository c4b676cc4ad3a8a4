"""Nearest neighbours by inner product: cross-polytope hashing with multiprobe tables, reranked exactly.

A vector is scaled by the largest norm and given one more number that makes it a unit vector; a query gets 0 there, so the order by
angle is the order by inner product. Three rounds of random signs and a fast Hadamard transform turn it; its hash is the signed axis that it lies nearest to,
and a table's bucket is the run of a few such hashes. A query probes the buckets of all tables in the order of their penalty: how
much farther its own axes are than the nearest ones, squared. Buckets are compared as matrices, block against block, and each query keeps the best
of what it met; inner products are those of the original vectors, in double precision.

How many buckets a query probes is measured, not guessed: for a bounded sample of queries the true neighbours are found against all
rows, and the probes are as many as reach RECALL of them. If even all buckets that can be ranked don't, hashes get one function fewer; with one function every
bucket can be probed, which finds all, so that no vector is out of reach.

Equal vectors are one node with the smallest of its ids, one more than a query returns, which is all that an answer can hold of them. A bucket of any size is
cut into blocks of rows and blocks of queries, each pair of blocks a group of its own. A query meets a few buckets first; of all others
it is given only what isn't worse than the last place of that.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, dropped, small_batches, stored, table
from .itq import grouped
from .vectors import common_length, finite, matrix

NEAREST, TABLES, EVERY = 20, 4, 20
#: Queries that the probes are measured on, in expectation, and the share of their true neighbours that has to be found.
SAMPLE_QUERIES, RECALL = 128, 0.96
#: Rows that a bucket is meant to hold, and buckets of a query that are ranked where hashes have several functions.
BUCKET_ROWS, MOST_PROBES = 256, 4096
#: Probes of the first table that are met before all others, to bound what has to be passed on.
FIRST_PROBES = 16
#: Rows and queries of a group, and queries that are multiplied at once.
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 2048, 1024, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Hadamard transform of each row; a row has a power of two numbers."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / sqrt(n)


class Index:
    """The turns of all tables and what a vector has to be scaled by; small, whatever the number of rows."""

    def __init__(self, length: int, largest: float, functions: int, tables: int = TABLES, seed: int = 7):
        self.length, self.largest, self.functions, self.tables = length, largest, functions, tables
        self.width = 1 << length.bit_length()  # room for the number that makes a unit vector
        drawn = np.random.default_rng(seed)
        self.signs = drawn.choice([-1.0, 1.0], (tables, functions, 3, self.width))

    def turned(self, unit: np.ndarray, t: int, f: int) -> np.ndarray:
        out = np.pad(unit, ((0, 0), (0, self.width - unit.shape[1])))
        for signs in self.signs[t, f]:
            out = hadamard(out * signs)
        return out

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        unit = x / self.largest
        unit = np.concatenate([unit, np.sqrt(np.maximum(1.0 - (unit * unit).sum(axis=1), 0.0))[:, None]], axis=1)
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for f in range(self.functions):
                y = self.turned(unit, t, f)
                axis = np.abs(y).argmax(axis=1)
                out[:, t] = out[:, t] * 2 * self.width + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return out

    def ranked(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Tables and buckets that each query probes, the least penalty first, so many or all that there are."""
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        axes, codes, costs = 2 * self.width, [], []
        for t in range(self.tables):
            code, cost = np.zeros((len(q), 1), np.int64), np.zeros((len(q), 1))
            for f in range(self.functions):
                y = self.turned(unit, t, f)
                near = np.stack([y, -y], axis=2).reshape(len(q), axes)
                penalty = (near.max(axis=1, keepdims=True) - near) ** 2
                few = np.argsort(penalty, axis=1, kind="stable")[:, :most]
                # The best runs of f functions are made of best runs of f - 1.
                cost = (cost[:, :, None] + np.take_along_axis(penalty, few, 1)[:, None, :]).reshape(len(q), -1)
                code = (code[:, :, None] * axes + few[:, None, :]).reshape(len(q), -1)
                best = np.argsort(cost, axis=1, kind="stable")[:, :most]
                cost, code = np.take_along_axis(cost, best, 1), np.take_along_axis(code, best, 1)
            codes.append(code)
            costs.append(cost)
        cost, code = np.concatenate(costs, axis=1), np.concatenate(codes, axis=1)
        at = np.repeat(np.arange(self.tables), [c.shape[1] for c in codes])
        best = np.argsort(cost, axis=1, kind="stable")[:, :most]
        return at[best], np.take_along_axis(code, best, 1)


def functions_for(rows: int, width: int) -> int:
    """Functions of a hash so that a bucket holds about BUCKET_ROWS by chance."""
    return max(1, min(6, round(log(max(1, rows / BUCKET_ROWS)) / log(2 * width))))


def best_of(query: np.ndarray, node: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of each query's ``most`` best nodes, a node that was met more than once taken once."""
    once = np.lexsort((node, query))
    once = once[np.append(True, (query[once][1:] != query[once][:-1]) | (node[once][1:] != node[once][:-1]))]
    order = once[np.lexsort((node[once], -score[once], query[once]))]
    start = np.append(True, query[order][1:] != query[order][:-1])
    place = np.arange(len(order)) - np.flatnonzero(start)[np.cumsum(start) - 1]
    return order[place < most]


def rerank(q: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, rows and inner products of each query's ``most`` best rows; equal pairs of vectors get equal products wherever they meet."""
    at, rows = [], []
    for a in range(0, len(q), AT_ONCE):
        scores = q[a : a + AT_ONCE] @ x.T
        k = min(most, x.shape[0])
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        at.append(np.repeat(np.arange(a, a + len(scores)), k))
        rows.append(best.ravel())
    at_, rows_ = np.concatenate(at), np.concatenate(rows)
    return at_, rows_, (q[at_] * x[rows_]).sum(axis=1)


FOUND = "query long, node long, score double"


def found_batch(query: np.ndarray, node: np.ndarray, score: np.ndarray, most: int) -> pa.RecordBatch:
    best = best_of(query, node, score, most)
    return pa.RecordBatch.from_arrays([pa.array(query[best]), pa.array(node[best]), pa.array(score[best])], names=["query", "node", "score"])


def brute_force(nodes: DataFrame, ids: np.ndarray, q: np.ndarray, most: int) -> DataFrame:
    """The ``most`` best nodes of a few queries against all nodes: the best of each task, to be merged."""
    held = nodes.sparkSession.sparkContext.broadcast((ids, q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_, q_ = held.value
        none = np.zeros(0, np.int64)
        query, node, score = none, none, np.zeros(0)
        for batch in batches:
            if batch.num_rows:
                at, rows, new = rerank(q_, matrix(batch.column("v"), q_.shape[1]), most)
                query, node, score = np.append(query, ids_[at]), np.append(node, batch.column("node").to_numpy()[rows]), np.append(score, new)
                best = best_of(query, node, score, most)
                query, node, score = query[best], node[best], score[best]
        yield found_batch(query, node, score, most)

    return nodes.mapInArrow(scan, FOUND)


def merged(found: DataFrame, most: int) -> DataFrame:
    """Each query's ``most`` best nodes of all that were found."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    return found.groupBy("query", "node").agg(F.max("score").alias("score")).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def measured(nodes: DataFrame, queries: DataFrame, n_queries: int, n_nodes: int, length: int, largest: float, most: int) -> tuple[Index, int]:
    """The index, and how many buckets a query has to probe to reach RECALL on a sample of the queries."""
    share = SAMPLE_QUERIES / max(1, n_queries)
    drawn = F.pmod(F.xxhash64("query", F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = queries.where(drawn < share).select("query", "v").toArrow() if share < 1 else queries.select("query", "v").toArrow()
    if not sample.num_rows:
        sample = queries.limit(SAMPLE_QUERIES).select("query", "v").toArrow()
    ids, q = sample["query"].to_numpy(), matrix(sample["v"].combine_chunks(), length)
    near = merged(brute_force(nodes, ids, q, most), most).join(nodes, "node").select("query", "v").toArrow()
    place = {k: i for i, k in enumerate(ids.tolist())}
    at, true = np.array([place[k] for k in near["query"].to_pylist()]), matrix(near["v"].combine_chunks(), length)
    functions = functions_for(n_nodes, 1 << length.bit_length())
    while True:
        index = Index(length, largest, functions)
        every = index.tables * (2 * index.width) ** functions
        tables, codes = index.ranked(q, every if functions == 1 else min(every, MOST_PROBES))
        own = index.buckets(true)
        ranks = np.full(len(true), np.iinfo(np.int64).max)
        for k in range(len(true)):
            hit = np.flatnonzero(codes[at[k]] == own[k][tables[at[k]]])
            if len(hit):
                ranks[k] = hit[0] + 1
        need = int(np.sort(ranks)[min(len(ranks) - 1, int(RECALL * len(ranks)))])
        if need <= tables.shape[1]:
            return index, need
        functions -= 1


def searched(nodes: DataFrame, queries: DataFrame, index: Index, probes: int, most: int) -> list[DataFrame]:
    """Stored tables (query, node, score): the best of each group of blocks that a query's probes meet, of its first probes and of the rest."""
    spark, tables = nodes.sparkSession, index.tables
    held = spark.sparkContext.broadcast(index)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = held.value.buckets(matrix(batch.column("v"), held.value.length))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), tables).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("v"), lists], names=["node", "v", "codes"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                at, codes = held.value.ranked(matrix(part.column("v"), held.value.length), probes)
                each = at.shape[1]
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), each).cast(pa.list_(pa.int64())) for c in (at.astype(np.int64), codes)]
                yield pa.RecordBatch.from_arrays([part.column("query"), part.column("v"), *lists], names=["query", "v", "tables", "codes"])

    entered = stored(nodes.mapInArrow(enter, "node long, v array<double>, codes array<long>"))
    probed = stored(queries.mapInArrow(probe, "query long, v array<double>, tables array<long>, codes array<long>"))
    rows = entered.select("node", "v", F.posexplode("codes").alias("t", "bucket"))
    pairs = F.transform(F.arrays_zip("tables", "codes"), lambda p: F.struct(p["tables"].cast("int").alias("t"), p["codes"].alias("bucket")))
    first = F.slice(F.filter(pairs, lambda p: p["t"] == 0), 1, FIRST_PROBES)
    start = probed.select("query", "v", F.lit(float("-inf")).alias("bound"), F.explode(first).alias("p"))
    found = met(rows.where("t = 0"), start.select("query", "v", "bound", "p.*"), index.length, most)
    # What a query has met by now is a lower bound of its answer: nothing worse is passed on.
    enough = found.groupBy("query", "node").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    bounds = enough.withColumn("n", place).where(F.col("n") == most).select("query", F.col("score").alias("bound"))
    rest = probed.join(bounds, "query", "left").select("query", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), F.explode(F.array_except(pairs, first)).alias("p"))
    more = met(rows, rest.select("query", "v", "bound", "p.*"), index.length, most)
    dropped(entered, probed)
    return [found, more]


def met(rows: DataFrame, asks: DataFrame, length: int, most: int) -> DataFrame:
    """A stored table (query, node, score): of the rows (node, v) of a bucket (t, bucket) the best for each query there, none below its bound."""
    n_rows, n_asks = rows.groupBy("t", "bucket").agg(F.count("*").alias("n")), asks.groupBy("t", "bucket").agg(F.count("*").alias("m"))
    blocks = [F.ceil(F.col(c) / most_).cast("int").alias(name) for c, most_, name in (("n", BLOCK_ROWS, "row_blocks"), ("m", BLOCK_QUERIES, "query_blocks"))]
    sizes = stored(n_rows.join(n_asks, ["t", "bucket"]).select("t", "bucket", *blocks))
    keys, every = ["t", "bucket", "rb", "qb"], lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x = rows.join(sizes, ["t", "bucket"]).withColumn("rb", F.pmod(F.xxhash64("node"), F.col("row_blocks")).cast("int")).withColumn("qb", every("query_blocks"))
    q = asks.join(sizes, ["t", "bucket"]).withColumn("qb", F.pmod(F.xxhash64("query"), F.col("query_blocks")).cast("int")).withColumn("rb", every("row_blocks"))
    both = x.select(*keys, F.lit(None).cast("double").alias("bound"), F.col("node").alias("id"), "v").unionByName(q.select(*keys, "bound", F.col("query").alias("id"), "v"))
    placed = both.repartition(*keys).sortWithinPartitions(*keys)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts, ends in grouped(batches, keys):
            v, ids = matrix(part["v"].combine_chunks(), length), part["id"].to_numpy()
            bound = part["bound"].to_numpy()
            asking = ~np.isnan(bound)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                query, node = a + np.flatnonzero(asking[a:b]), a + np.flatnonzero(~asking[a:b])
                if len(query) and len(node):
                    at, row, score = rerank(v[query], v[node], most)
                    good = score >= bound[query[at]]
                    out.append((ids[query[at[good]]], ids[node[row[good]]], score[good]))
            if out:
                yield found_batch(*(np.concatenate(c) for c in zip(*out, strict=True)), most)

    found = stored(placed.mapInArrow(meet, FOUND))
    dropped(sizes)
    return found


def nearest_by_product(rows: DataFrame, is_query: str, nearest: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the rows of largest inner product of each query, nearest first, ties to the smaller id.

    ``is_query`` is a SQL condition on the column ``id`` that says which rows ask. A query's candidates are all rows with another id than its
    own. Null, empty and zero vectors and those that hold a null or non-finite number take no part, nor do those of another length than
    most have (of equally frequent lengths the longest). A row that is there twice is one candidate; queries of one id
    and one vector are one query. Rows without an id can be found, after all others of their score, and never ask. Of two different
    vectors that tie, in the last place, past rounding, either may be found. Neighbours are found with a recall of about RECALL, measured on a
    sample of the queries; an answer may hold fewer than ``nearest`` rows only where its probes met fewer. An empty table, or one without queries, gives an empty table. Of columns only the two are
    read, whatever the names of others.
    """
    spark, most = rows.sparkSession, nearest + 1
    kind = rows.schema[id_col].dataType.simpleString()
    kept = rows.select(column(id_col).alias("id"), column(vec_col).alias("v")).where(finite("v") & F.exists("v", lambda c: c != 0))
    length = common_length(kept, "v")
    none = spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    if not length:
        return none
    v = F.transform("v", lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double")))  # -0 is 0
    kept = kept.where(F.size("v") == length).select("id", v.alias("v")).withColumn("h", F.xxhash64("v"))
    small_batches(spark)
    once = kept.groupBy("h", "v", "id").agg(F.lit(1).alias("one"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy(F.asc_nulls_last("id")))).where(F.col("n") <= most)
    by_vector = first.groupBy("h", "v").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("ids"))
    nodes = stored(by_vector.select(F.monotonically_increasing_id().alias("node"), "h", "v", F.transform("ids", lambda s: s["id"]).alias("ids")))
    asked = kept.where(is_query).select("id", "h", "v").distinct()
    asking = stored(asked.join(nodes.select("h", "v", F.col("node").alias("query")), ["h", "v"]).select(F.col("id").alias("query_id"), "query"))
    own = nodes.join(asking.select(F.col("query").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("query"), "v")
    queries = stored(own)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    n_nodes, largest = nodes.agg(F.count("*"), F.max(norm)).first()
    n_queries = queries.count()
    if not n_queries:
        return none
    index, probes = measured(nodes.select("node", "v"), queries, n_queries, n_nodes, length, largest, most)
    found = searched(nodes.select("node", "v"), queries, index, probes, most)
    best = merged(found[0].unionByName(found[1]), most).join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("id"))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    first = best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("n") <= most)
    listed = stored(first.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("best")))
    dropped(*found, nodes, queries)
    others = F.slice(F.filter("best", lambda s: ~s["id"].eqNullSafe(F.col("query_id"))), 1, nearest)
    out = asking.join(listed, "query").select("query_id", F.posexplode(others).alias("k", "s"))
    return out.select("query_id", (F.col("k") + 1).alias("rank"), F.col("s.id").alias(id_col), F.col("s.score").alias("score"))


def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all other vectors to each whose id is divisible by 20."""
    return nearest_by_product(table(spark, sf_dir, "embeddings"), f"id % {EVERY} = 0")
