"""N-gram Jaccard join by token-combination prefixes.

The tokens of a document are its distinct word shingles, all in one global order: rare ones first,
then frequent ones by how many documents hold them. If two sets reach the similarity, each misses few
of the other's tokens, so their prefixes meet. Prefixes are extended until that holds for
*combinations*: a rare token is indexed by itself, tokens of class k (2 or 3) only k together, within
small hash groups of the class that keep the combinations in proportion to the set. A prefix with n
tokens in a group of class k covers max(0, n - k + 1) misses; it ends when it covers one more than the
similarity allows. Two similar sets then share an indexed combination:
let the prefix that ends first be x's. If x and y shared fewer than k tokens of it in each group, x
would miss more tokens than allowed.

How the work is dealt out, so that no group of copies becomes pairs within a group:

1. One pass over the texts gives each document's node (a distinct set), size and sketch, and counts tokens over
   all documents (lossy counting: each chunk of a task passes on what it holds twice or more). The table of
   frequent tokens is a bounded number of entries. It steers only the order, never the result.
2. A second pass makes the keys of each node. A task packs them, sorted, into one row for each range of keys,
   14 bytes and a size for a key, so that the shuffle carries no row of its own for each of them; keys of very
   frequent tokens are salted. The nodes of a range's buckets are found by sorting the range. Every node of a
   bucket is paired with at most three leaders of it, if their sizes allow the similarity.
3. Pairs are pruned by exact bounds from sizes and parity bitmaps, then verified on the texts.
4. Buckets of four or more nodes that still hold several components are joined in full, but only across
   components and only for nodes that weren't leaders; the same bounds hold inside the join.
   After that no pair of a bucket is untested unless both are in one component already.
5. Links become components; a document's class is the smallest doc_id of its component.

Sets are of 64-bit hashes of shingles, and a node is the 64-bit fingerprint of its set: both are taken for what
they stand for, and two different ones of N are alike with probability of about N * N / 2**65.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import column, dropped, free_name, pieces, release, stored, table
from .components import connected_components
from .shingles import fingerprint, mix, shingle_sets

#: Shares of the documents from which on a token is of class 2 and of class 3, and the least counts for that.
CLASS_SHARES, CLASS_LEAST = (2e-4, 2e-3), (8, 64)
#: Most entries of the table of frequent tokens (16 bytes each); the rest count as rare, which is always right.
FREQUENT_TOKENS = 1 << 16
#: Sets below this size index single tokens only.
SMALL_SET = 64
#: A bucket is salted so that about so many documents share a salt.
SALT_ROWS = 1000
#: Shingles counted together by a task, and keys packed together.
COUNT_CHUNK, PACK_KEYS = 1 << 21, 1 << 20
#: Keys of a range, about; a group of a reduce task is one range. There are at least so many ranges.
RANGE_KEYS, LEAST_RANGES = 1 << 19, 512
#: Sizes go with keys in steps of one part in a hundred, and may differ by so many steps (a similarity of p percent allows a ratio of 100 / p).
SIZE_STEP = 1.01
#: Rows of packed keys in one batch.
PACK_ROWS = 1024
#: Nodes whose texts are fetched by a broadcast of their hashes, 16 bytes each; more are fetched by a shuffle.
BROADCAST_NODES = 200_000
#: Bits of a sketch; sets of at most HALF_BITS tokens have half of them, as good for them as all are for sets twice as large.
BITS = 1024
HALF_BITS = BITS // 2
WORDS64 = BITS // 64
#: Of a node's keys before a row's own, the row carries so many: similar nodes share one of them, so that few pairs are made twice.
LEAST_KEYS = 8
_RANK = np.uint64(0x9E3779B97F4A7C15)


SCANNED = [
    StructField("node", LongType()),
    StructField("n_shingles", LongType()),
    StructField("bits", ArrayType(LongType(), False)),
    StructField("sketch", ArrayType(LongType(), False)),
    StructField("token", LongType()),
    StructField("count", LongType()),
]


def scanned(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document (its node and size, and the sketches for the first document of a node within a task), and rows of counted tokens.

    ``docs`` has ``__id`` and ``__text``. Copies within a task count once. A token's sum is low by at most one for each chunk.
    """
    docs = docs.select("__id", F.xxhash64("__text").alias("__hash"), "__text")
    schema = StructType([StructField("__id", docs.schema["__id"].dataType), StructField("__hash", LongType()), *SCANNED])
    lists = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size, id_kind = [], 0, None

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= 2
            k = int(many.sum())
            arrays = [pa.nulls(k, id_kind), pa.nulls(k, pa.int64()), *(pa.nulls(k, t) for t in lists), pa.array(tokens[many].view(np.int64)), pa.array(counts[many])]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in (p for b in batches for p in pieces(b, [2])):
            id_kind = batch.column(0).type
            made: list[list] = [[], [], [], []]
            for shingles in shingle_sets(batch.column(2).to_pylist(), n):
                node = fingerprint(shingles) if len(shingles) else None
                row = [node, len(shingles), None, None]
                if node is not None and node not in seen:
                    seen.add(node)
                    row[2:] = sketches(shingles)
                    held.append(shingles)
                    size += len(shingles)
                for values, value in zip(made, row, strict=True):
                    values.append(value)
            empty = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, made, lists), empty, empty], names=schema.names)
            if size >= COUNT_CHUNK:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()
        held, seen = [], set()
        release()

    return docs.mapInArrow(scan, schema)


def frequent_tokens(index: DataFrame, total: int, limit: int = FREQUENT_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the tokens that many of the ``total`` documents hold."""
    least = max(CLASS_LEAST[0], int(total * CLASS_SHARES[0]))
    sums = index.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count"))
    rows = sums.where(F.col("count") >= least).orderBy(F.desc("count"), "token").limit(limit).collect()
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    counts = np.array([r["count"] for r in rows], np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def allowed_misses(size: int, percent: int) -> int:
    """Most tokens of a set of this size that a set as similar as ``percent`` can lack."""
    return size - -(-percent * size // 100)


def prefix_keys(shingles: np.ndarray, counts: np.ndarray, least3: int, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """What a set is indexed by: single rare tokens, and (key, document count) of the frequent part of its prefix.

    ``counts`` has 0 for rare tokens. Sets whose sizes differ enough to stand in neighbouring power-of-two
    bands meet in the lower band's groups, so a set near the lower end of its band is indexed in both.
    """
    size = len(shingles)
    need = allowed_misses(size, percent) + 1
    rare = shingles[counts == 0]
    if len(rare) >= need:
        return rare[:need], []
    many = counts > 0
    tokens, held = shingles[many], counts[many]
    order = np.lexsort((tokens, held))
    tokens, held = tokens[order], held[order]
    band = size.bit_length() - 1
    bands = [band] + [band - 1] * (-(-percent * size // 100) < 1 << band)
    keys: dict[int, int] = {}
    for b in bands:
        covered = len(rare)
        if 1 << b < SMALL_SET:
            for token, count in zip(tokens[: need - covered].tolist(), held.tolist(), strict=False):
                keys[token] = count
            continue
        n_groups = (1 << b) // 16
        groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
        places = (mix(tokens ^ _RANK) % np.uint64(n_groups)).tolist()
        for token, count, place in zip(tokens.tolist(), held.tolist(), places, strict=True):
            if covered >= need:
                break
            k = 3 if count >= least3 else 2
            group = groups.setdefault((k, place), [])
            group.append((token, count))
            covered += len(group) >= k
        for (k, place), group in groups.items():
            drawn = list(combinations(group, k))
            if drawn:
                parts = np.array([[t for t, _ in c] for c in drawn], np.uint64)
                whole = mix(np.sort(parts, axis=1) * np.arange(1, 2 * k, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                whole = mix(whole + np.array([(b * 4 + k) * 65_536 + place], np.uint64))
                for key, c in zip(whole.tolist(), drawn, strict=True):
                    keys[key] = min(count for _, count in c)
    return rare, list(keys.items())


def parity_words(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Parities of so many classes of tokens; the bits in which two sets' differ are no more than the tokens in which the sets differ."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The parities in BITS classes (half as many for small sets), and those in two to four times as many classes as tokens where that is more."""
    if len(shingles) <= HALF_BITS:
        return parity_words(shingles, HALF_BITS), None
    wide = 1 << (2 * len(shingles) - 1).bit_length()
    words = parity_words(shingles, wide)
    return np.bitwise_xor.reduce(words.reshape(-1, WORDS64)), words


def packed_keys(docs: DataFrame, frequent: Broadcast, n: int, percent: int, least3: int, ranges: int) -> DataFrame:
    """The keys of every node, packed: a row for each range of keys that a task's pack has any in, salted keys apart.

    Keys of a bucket without a salt lose their last 16 bits: buckets that fall together for that are only larger.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_counts = frequent.value
        seen: set[int] = set()
        held: list[list[np.ndarray]] = [[], [], [], []]  # keys, salts, nodes, sizes
        size = 0

        def packs() -> Iterator[pa.RecordBatch]:
            keys, salts, nodes, sizes = (np.concatenate(h) for h in held)
            for salted in (False, True):
                own = np.flatnonzero((salts > 0) == salted)
                if not len(own):
                    continue
                place = mix(keys[own] + salts[own].astype(np.uint64) * _RANK) if salted else keys[own]
                order = np.argsort(place)
                own, place = own[order], place[order]
                parts = ((place >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                edges = np.flatnonzero(np.diff(parts, prepend=-1, append=-1))
                raw_keys = keys[own].view(np.uint8).reshape(-1, 8) if salted else np.ascontiguousarray(keys[own].view(np.uint8).reshape(-1, 8)[:, 2:])
                raw = [raw_keys, salts[own].view(np.uint8).reshape(-1, 4), nodes[own].view(np.uint8).reshape(-1, 8), sizes[own].view(np.uint8).reshape(-1, 2)]
                for at in range(0, len(edges) - 1, PACK_ROWS):
                    ends = edges[at : at + PACK_ROWS + 1].tolist()
                    cut_ = [[r[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)] if salted or k != 1 else [None] * (len(ends) - 1) for k, r in enumerate(raw)]
                    firsts = [pa.array(parts[ends[:-1]]), pa.array([salted] * (len(ends) - 1))]
                    yield pa.RecordBatch.from_arrays([*firsts, *(pa.array(c, pa.binary()) for c in cut_)], names=["part", "salted", "keys", "salts", "nodes", "sizes"])

        for batch in (p for b in batches for p in pieces(b, [0])):
            for shingles in shingle_sets(batch.column(0).to_pylist(), n):
                node = fingerprint(shingles) if len(shingles) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                counts = np.zeros(len(shingles), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
                    counts = np.where(known[at] == shingles, known_counts[at], 0)
                rare, keys = prefix_keys(shingles, counts, least3, percent)
                salts = np.array([1 + c // SALT_ROWS for _, c in keys], np.uint64)
                drawn = mix(np.array([node], np.int64).view(np.uint64))[0] % np.maximum(salts, np.uint64(1))
                own = np.concatenate([rare, np.array([k for k, _ in keys], np.uint64)])
                held[0].append(own)
                held[1].append(np.concatenate([np.zeros(len(rare), np.uint32), np.where(salts > 1, drawn + np.uint64(1), 0).astype(np.uint32)]))
                held[2].append(np.full(len(own), node, np.int64))
                held[3].append(np.full(len(own), int(np.log(len(shingles)) / np.log(SIZE_STEP)), np.uint16))
                size += len(own)
                if size >= PACK_KEYS:
                    yield from packs()
                    held, size = [[], [], [], []], 0
        if size:
            yield from packs()
        held, seen = [[], [], [], []], set()
        release()

    return docs.select("__text").mapInArrow(pack, "part long, salted boolean, keys binary, salts binary, nodes binary, sizes binary")


def buckets(packed: DataFrame, percent: int) -> DataFrame:
    """The nodes of the buckets of several nodes, and of all salted ones: key, salted, node, how many nodes, the leaders to test it with, whether it leads.

    ``low`` and ``high``, the smallest and the largest node, are given for salted buckets, whose keys have other buckets too.
    """
    most = int(np.log(100 / percent) / np.log(SIZE_STEP)) + 2

    def sort_range(group: pa.Table) -> pa.Table:
        raw = {c: np.frombuffer(b"".join(x for x in group.column(c).to_pylist() if x is not None), np.uint8) for c in ("keys", "salts", "nodes", "sizes")}
        nodes, sizes = raw["nodes"].view(np.int64), raw["sizes"].view(np.uint16).astype(np.int64)
        salted = bool(group.column("salted")[0].as_py())
        if salted:
            keys, salts = raw["keys"].view(np.uint64), raw["salts"].view(np.uint32)
        else:
            whole = np.zeros((len(nodes), 8), np.uint8)
            whole[:, 2:] = raw["keys"].reshape(-1, 6)
            keys, salts = whole.view(np.uint64).ravel(), np.zeros(len(nodes), np.uint32)
        order = np.lexsort((nodes, salts, keys))
        keys, salts, nodes, sizes = keys[order], salts[order], nodes[order], sizes[order]
        new_bucket = np.append(True, (keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1]))
        fresh = new_bucket | np.append(True, nodes[1:] != nodes[:-1])
        keys, nodes, sizes, new_bucket = keys[fresh], nodes[fresh], sizes[fresh], new_bucket[fresh]
        starts = np.flatnonzero(new_bucket)
        counts = np.diff(np.append(starts, len(keys)))
        hashes = mix(nodes.view(np.uint64) ^ _RANK)
        third = np.flatnonzero(hashes == np.repeat(np.minimum.reduceat(hashes, starts), counts))
        rows, place = np.repeat(counts, counts), np.arange(len(keys))
        leaders = np.repeat(np.stack([starts, starts + counts - 1, third]), counts, axis=1)
        near = (np.abs(sizes[leaders] - sizes) <= most) & (leaders != place)
        near[1] &= place != leaders[0]  # the other end has this pair already
        near[2] &= (leaders[2] != leaders[0]) & (leaders[2] != leaders[1])
        kept = np.flatnonzero(near.any(axis=0) | (rows >= 4) | salted)
        own = near[:, kept].T
        ends = np.concatenate([[0], np.cumsum(own.sum(axis=1))]).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(ends), pa.array(nodes[leaders[:, kept].T[own]]))
        edge = [pa.array(nodes[leaders[k, kept]]) if salted else pa.nulls(len(kept), pa.int64()) for k in (0, 1)]
        leads = (leaders[:, kept] == place[kept]).any(axis=0)
        arrays = [pa.array(keys[kept].view(np.int64)), pa.array(np.full(len(kept), salted)), pa.array(nodes[kept]), pa.array(rows[kept]), found, pa.array(leads), *edge]
        return pa.Table.from_arrays(arrays, names=["key", "salted", "node", "rows", "leaders", "leads", "low", "high"])

    schema = "key long, salted boolean, node long, rows long, leaders array<long>, leads boolean, low long, high long"
    return packed.groupBy("part", "salted").applyInArrow(sort_range, schema)


def node_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the wanted nodes, which come with the hash of one of their texts.

    Few nodes are broadcast, so that only their texts move; more are joined by a shuffle.
    """
    wanted = stored(wanted)
    small = wanted.count() <= BROADCAST_NODES
    hashed = docs.select(F.xxhash64("__text").alias("__hash"), "__text")
    found = hashed.join(F.broadcast(wanted) if small else wanted, "__hash")
    return found.select("node", F.col("__text").alias("text")).dropDuplicates(["node"])


def can_link(size_a: Column, size_b: Column, differ: Column, percent: int) -> Column:
    """False only where no sets of these sizes with at least ``differ`` differing tokens reach the similarity."""
    return (100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)) & ((100 + percent) * differ <= (100 - percent) * (size_a + size_b))


def bit_words(bits: Column) -> list[Column]:
    """The words of a sketch; those that a small set's lacks are 0."""
    return [F.coalesce(F.get(bits, F.lit(i)), F.lit(0).cast("long")) for i in range(WORDS64)]


def bits_differ(a: list[Column], b: list[Column], size_a: Column, size_b: Column) -> Column:
    """Bits in which two sketches differ; both are folded to half if one of the sets is small."""

    def differ(x: list[Column], y: list[Column]) -> Column:
        each = [F.bit_count(p.bitwiseXOR(q)) for p, q in zip(x, y, strict=True)]
        return sum(each[1:], each[0])

    half = WORDS64 // 2
    fold = lambda w: [p.bitwiseXOR(q) for p, q in zip(w[:half], w[half:], strict=True)]
    return F.when(F.least(size_a, size_b) <= HALF_BITS, differ(fold(a), fold(b))).otherwise(differ(a, b))


def wide_differ(a: Column, b: Column) -> Column:
    """Bits in which two wide sketches differ; the longer one, of similar sets twice as long at most, is folded first."""
    half = lambda x: F.shiftright(F.size(x), 1)
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q))
    folded_a, folded_b = F.when(F.size(a) > F.size(b), fold(a)).otherwise(a), F.when(F.size(b) > F.size(a), fold(b)).otherwise(b)
    return F.aggregate(F.zip_with(folded_a, folded_b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0)))


def verified(pairs: DataFrame, meta: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity, by comparing the sets of their texts."""
    ends = {}
    for end in "ab":
        ends[end] = meta.select(F.col("node").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))
    near = pairs.join(ends["a"], "a").join(ends["b"], "b")
    differ = bits_differ(bit_words(F.col("bits_a")), bit_words(F.col("bits_b")), F.col("n_a"), F.col("n_b"))
    near = closer = stored(near.where(can_link(F.col("n_a"), F.col("n_b"), differ, percent)).select("a", "b"))
    wide = {end: meta.select(F.col("node").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}")) for end in "ab"}
    near = near.join(wide["a"], "a").join(wide["b"], "b")
    possible = F.col("s_a").isNull() | F.col("s_b").isNull() | can_link(F.col("n_a"), F.col("n_b"), wide_differ(F.col("s_a"), F.col("s_b")), percent)
    near = stored(near.where(possible).select("a", "b"))
    dropped(closer)
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(meta.select("node", "__hash"), "node")
    texts = stored(node_texts(docs, wanted))
    both = near.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    both = both.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sets = []
                for end in "ab":
                    own = []
                    for node, text in zip(batch.column(end).to_pylist(), batch.column(f"text_{end}"), strict=True):
                        if node not in kept:
                            kept[node] = next(shingle_sets([text.as_py()], n))
                            if len(kept) > 512:
                                kept.popitem(last=False)
                        own.append(kept[node])
                    sets.append(own)
                linked = []
                for x, y in zip(*sets, strict=True):
                    shared = len(x) + len(y) - len(np.union1d(x, y))
                    linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
                batch = batch.filter(pa.array(linked, pa.bool_()))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def link_components(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """All documents (``__id``, node, n_shingles), the component of each linked node, and the tables that these two read."""
    spark = docs.sparkSession
    scan = stored(scanned(docs, n))
    index = scan.where("token IS NULL")
    total, shingles = index.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    tokens, counts = frequent_tokens(scan, total)
    least3 = max(CLASS_LEAST[1], int(total * CLASS_SHARES[1]))
    ranges = max(LEAST_RANGES, shingles * (100 - percent) // 100 // RANGE_KEYS)
    held = stored(buckets(packed_keys(docs, spark.sparkContext.broadcast((tokens, counts)), n, percent, least3, ranges), percent))
    meta = stored(index.where("bits IS NOT NULL").select("node", "n_shingles", "bits", "sketch", "__hash").dropDuplicates(["node"]))

    led = held.select("node", F.explode("leaders").alias("leader"))
    salted = held.where("salted").select("key", "low", "high").distinct()
    tops = salted.groupBy("key").agg(F.min("low").alias("top"))
    across = salted.join(tops, "key").select(F.explode(F.array("low", "high")).alias("node"), F.col("top").alias("leader"))
    pairs = led.unionByName(across).where("node <> leader").select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b"))
    links = stored(verified(pairs.distinct(), meta, docs, n, percent))
    first = connected_components(links)

    # Buckets that still hold several components: every pair that no leader was part of, across components.
    open_rows = held.where("rows >= 4 OR salted").select("key", "salted", "node", "leads").join(first, "node", "left")
    open_rows = open_rows.withColumn("component", F.coalesce("component", "node"))
    spread = open_rows.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("two")).where("one <> two").select("key")
    open_rows = open_rows.where("salted OR NOT leads")
    open_rows = stored(open_rows.join(spread, "key", "left_semi").select("key", "node", "component").distinct())
    dropped(held)
    # Keys of equal buckets, such as those of one passage, count once; of a pair's other common keys, mostly the smallest does.
    filled = open_rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"))
    once = filled.where("n > 1").groupBy("n", "one", "two").agg(F.min("key").alias("key")).select("key")
    every, open_rows = open_rows, stored(open_rows.join(once, "key", "left_semi"))
    dropped(every)
    by_key = Window.partitionBy("node").orderBy("key")
    open_rows = open_rows.withColumn("place", F.row_number().over(by_key))
    before = F.collect_list(F.when(F.col("place") <= LEAST_KEYS, F.col("key"))).over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    narrow, open_rows = open_rows, open_rows.withColumn("smaller", before).join(meta.select("node", "n_shingles", "bits"), "node")
    names = [f"w{i}" for i in range(WORDS64)]
    open_rows = stored(open_rows.select("key", "node", "component", "n_shingles", "smaller", *[c.alias(w) for c, w in zip(bit_words(F.col("bits")), names, strict=True)]))
    dropped(narrow)
    x, y = open_rows.alias("x"), open_rows.alias("y")
    differ = bits_differ([F.col(f"x.{w}") for w in names], [F.col(f"y.{w}") for w in names], F.col("x.n_shingles"), F.col("y.n_shingles"))
    left = x.join(
        y,
        (F.col("x.key") == F.col("y.key")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
        & can_link(F.col("x.n_shingles"), F.col("y.n_shingles"), differ, percent)
        & ~F.arrays_overlap("x.smaller", "y.smaller"),
    )
    left = stored(left.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    dropped(open_rows)
    if left.isEmpty():
        dropped(left, links, meta)
        return index, first, [scan, first]
    more = stored(verified(left, meta, docs, n, percent))
    both = connected_components(links.unionByName(more))
    dropped(left, links, more, meta, first)
    return index, both, [scan, both]


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row of ``docs``: exact for every pair of different texts.

    Two rows link when ``100 * shared >= percent * all`` of their distinct ``n``-word shingles, A-Z
    lower-cased; a text with fewer words is one shingle. Null and wordless texts have no shingles and
    link with nothing: their component is their own id. ``component_id`` is the smallest non-null id
    reachable by links; it is null only where every id reachable is. Repeated rows are in one
    component. An empty table gives an empty table; other columns are not looked at. ``percent`` is from
    50 to 100: below, sets that link could lie more than one band of sizes apart, which the index doesn't join.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    docs = docs.select(column(id_col).alias("__id"), column(text_col).alias("__text"))
    return _classes(docs, n, percent)[0].withColumnRenamed("__id", id_col)


def _classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """``__id``, n_shingles and component_id of all documents, and the tables that this reads."""
    index, components, tables = link_components(docs, n, percent)
    own = index.where("node IS NOT NULL").groupBy("node").agg(F.min("__id").alias("least"))
    own = own.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = stored(own.select("node", "component").join(least, "component").select("node", "component_id"))
    full = index.where("node IS NOT NULL").select("__id", "node", "n_shingles").join(classes, "node", "left")
    empty = index.where("node IS NULL").select("__id", "n_shingles", F.col("__id").alias("component_id"))
    return full.select("__id", "n_shingles", "component_id").unionByName(empty), [*tables, classes]


#: Keys of rows that go, or are repeated, up to this number are broadcast (some 64 bytes each), so that no text moves; more are joined by a shuffle.
BROADCAST_GONE = 500_000


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one of each component stays: the one of the smallest id, then of the smallest hash of its text.

    Rows of one id with different texts are rows of their own. Of rows repeated with id and text one stays.
    Rows with a null id, which no result can name, all stay, as do empty texts of different ids. Other columns
    stay as they are, whatever their names; an empty table gives an empty table.
    """
    id_, hash_, fate = (free_name(docs, x) for x in ("_id", "_hash", "_fate"))
    keyed = docs.withColumn(id_, column(id_col)).withColumn(hash_, F.xxhash64(column(text_col)))
    rows = keyed.where(F.col(id_).isNotNull()).select(F.struct(F.col(id_).alias("id"), F.col(hash_).alias("hash")).alias("__id"), column(text_col).alias("__text"))
    joined, tables = _classes(rows, n, percent)
    each = joined.groupBy("__id").agg(F.bool_or(F.col("__id") == F.col("component_id")).alias("kept"), F.count("*").alias("rows"))
    each = each.where("NOT kept OR rows > 1").select(F.col("__id.id").alias(id_), F.col("__id.hash").alias(hash_), F.when(F.col("kept"), "repeated").otherwise("gone").alias(fate))
    fates = stored(each)
    dropped(*tables)
    few = fates.count() <= BROADCAST_GONE
    told = keyed.join(F.broadcast(fates) if few else fates, [id_, hash_], "left")
    out = told.where(F.col(fate).isNull())
    if not fates.where(F.col(fate) == "repeated").isEmpty():
        out = out.unionByName(told.where(F.col(fate) == "repeated").dropDuplicates([id_, hash_]))
    return out.select(*[column(c) for c in docs.columns])


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of shingles and the smallest id among the documents that links reach."""
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
