"""URL filters over a sorted digest array.

Every rule (host, path) becomes the 64-bit xxhash of ``host + path``. The digests, sorted, and the
rules' strings beside them go to a file in the shared folder, which Spark hands to each executor; tasks memory-map it, so
that a list of any length costs no heap and its pages are shared by the workers of a machine. A url
is probed with each of its host's suffixes joined with each prefix of its path that is as long as
some rule's path, in one vectorised binary search for a batch of urls; a digest that is found is
confirmed by comparing the full strings, so that colliding digests never decide.

No shuffle; the probes of a url are bounded by its labels times the distinct lengths of rule paths.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from .common import add_columns, column, ensure_shared_dir, table

#: Urls probed together.
PIECE = 10_000
#: (verdict, host, path) of the rules that the query applies.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest_bytes(rules: Iterable[tuple[str, str, str]]) -> Iterator[bytes]:
    """The file of the rules' sorted digests, piece by piece.

    Layout: count and number of distinct path lengths (two 64-bit numbers), the lengths, digests, offsets
    (count + 1), verdicts (0 allow, 1 block, as 64-bit), then the strings ``host + path`` in UTF-8. A rule
    given twice counts as its first.
    """
    first: dict[str, tuple[int, int]] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        first.setdefault(host + path, (int(verdict == "block"), len(path)))
    keys = sorted(first, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    raw = [k.encode() for k in keys]
    offsets = np.zeros(len(keys) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    lengths = np.array(sorted({n for _, n in first.values()}), np.int64)
    yield np.array([len(keys), len(lengths)], np.int64).tobytes()
    yield lengths.tobytes()
    yield np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64).tobytes()
    yield offsets.tobytes()
    yield np.array([first[k][0] for k in keys], np.int64).tobytes()
    for at in range(0, len(raw), 1 << 16):
        yield b"".join(raw[at : at + (1 << 16)])


def share_digests(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Writes the rules' file into the shared folder and has Spark hand it to every executor that runs a task; returns its name there."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_shared_dir(spark).rstrip('/')}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path)
    try:
        for part in digest_bytes(rules):
            for at in range(0, len(part), 4 << 20):
                out.write(bytearray(part[at : at + (4 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


class DigestArray:
    """A memory-mapped file of ``write_digests``."""

    def __init__(self, path: str) -> None:
        whole = np.memmap(path, np.uint8, "r")
        count, n_lengths = (int(x) for x in whole[:16].view(np.int64))
        at = 16
        self.lengths = whole[at : (at := at + 8 * n_lengths)].view(np.int64)
        self.digests = whole[at : (at := at + 8 * count)].view(np.uint64)
        self.offsets = whole[at : (at := at + 8 * (count + 1))].view(np.int64)
        self.blocked = whole[at : (at := at + 8 * count)].view(np.int64)
        self.strings = whole[at:]

    def find(self, keys: Sequence[str]) -> np.ndarray:
        """The index of each key's rule, or -1. Equal digests stand together; each is compared in full."""
        wanted = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        lo = np.searchsorted(self.digests, wanted, "left")
        hi = np.searchsorted(self.digests, wanted, "right")
        found = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero(hi > lo):
            raw = keys[i].encode()
            for j in range(lo[i], hi[i]):
                if self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == raw:
                    found[i] = j
                    break
        return found

    def string(self, i: int) -> str:
        return self.strings[self.offsets[i] : self.offsets[i + 1]].tobytes().decode()


def judge(rules: DigestArray, hosts: Sequence[str], paths: Sequence[str], default: str) -> tuple[list[str | None], list[str]]:
    """Rule string and verdict of each url; of the rules that fit, the longest string wins, then the longer host."""
    keys, owner, host_size = [], [], []
    lengths = [int(n) for n in rules.lengths]
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        starts = [0, *(k + 1 for k, c in enumerate(host) if c == ".")] if host else []
        for n in lengths:
            if n <= len(path):
                for s in starts:
                    keys.append(host[s:] + path[:n])
                    owner.append(i)
                    host_size.append(len(host) - s)
    best: dict[int, tuple[int, int, int]] = {}
    found = rules.find(keys)
    for k in np.flatnonzero(found >= 0):
        rank = (len(keys[k]), host_size[k], int(found[k]))
        best[owner[k]] = max(best.get(owner[k], rank), rank)
    texts = [rules.string(best[i][2]) if i in best else None for i in range(len(hosts))]
    verdicts = [("block" if rules.blocked[best[i][2]] else "allow") if i in best else default for i in range(len(hosts))]
    return texts, verdicts


def filter_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule
    decides, and ``default`` where none fits. Null urls and urls without ``://`` have an empty host
    and path, which no rule fits; a url of any length is judged whole. Repeated rows are each judged.
    Columns of ``pages`` that are named as an output are dropped, all others stay; an empty table gives an
    empty table. The rule list is read once, on the driver, and never held by a task.
    """
    name = share_digests(pages.sparkSession, rules)
    kept = [column(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    url = column(url_col)
    pages = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))

    def start():
        digests = DigestArray(SparkFiles.get(name))

        def make(hosts: pa.Array, paths: pa.Array) -> list[pa.Array]:
            texts, verdicts = judge(digests, hosts.to_pylist(), paths.to_pylist(), default)
            return [pa.array(texts, pa.string()), pa.array(verdicts, pa.string())]

        return make

    return add_columns(pages, ["host", "path"], [StructField("rule", StringType()), StructField("verdict", StringType())], start, rows=PIECE)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host and path, the rule that decides, and its verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH r(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), p AS (
  SELECT row_number() OVER () AS row_id, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), m AS (
  SELECT p.*, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY row_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
