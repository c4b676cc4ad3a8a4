"""The queries and the pipeline's stages against their contracts, on a folder of hard rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

import corpus_pipeline
from pennyflow import llm
from pennyflow.llm import flac, url_filter

from .conftest import ROWS
from .test_operators import brute_components

URLS = [
    "http://a.example.org/en/12", "http://a.example.org/en/12", "https://X.COM/de/x?y", "x://org", "x://org/", None, "no scheme", "", "a://b://com/de/", "http://com/fr/#x", "http://notexample.org/es/" + "y" * 20_000,
]
EMPTY = ("documents", "labels", "pages", "embeddings")


def embeddings():
    drawn = np.random.default_rng(11)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            centre = drawn.normal(size=12)
            rows += [((centre + drawn.normal(size=12) * 0.03 * k).astype(np.float32).tolist(), label) for k in range(4)]
    rows += [(rows[0][0], 0), (None, 0), ([0.0] * 12, 0), ([float("nan")] * 12, 0), ([None] * 12, 1)]
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (None, 1, 1), (8, None, None), (10, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(embeddings(), "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def bare(spark, folder, tmp_path_factory):
    """The same tables without a row."""
    path = str(tmp_path_factory.mktemp("bare"))
    for name in EMPTY:
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


def run(spark, folder, number):
    name = next(n for n in llm.queries() if n.startswith(f"op{number}_"))
    return llm.queries()[name](spark, folder)


COLUMNS = {
    1: {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    2: {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    3: {"doc_id": "bigint", "n_tokens_before": "bigint", "n_tokens_after": "bigint"},
    4: {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    5: {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    6: {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    7: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    8: {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    9: {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    10: {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    11: {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    12: {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    13: {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
}


@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_columns_and_empty_tables(spark, bare, number):
    out = run(spark, bare, number)
    types = dict(out.dtypes)
    assert {k: types.get(k) for k in COLUMNS[number]} == COLUMNS[number]
    assert out.count() == 0


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
@pytest.mark.parametrize("small", [True, False])
def test_oracles(spark, folder, name, small):
    path = "/root/testdata/sf0.001" if small else folder
    con = duckdb.connect()
    for f in os.listdir(path):
        source = f"{path}/{f}" + ("/*.parquet" if os.path.isdir(f"{path}/{f}") else "")
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{source}'")
    show = lambda v: "-" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = lambda df: sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(llm.queries()[name](spark, path).toPandas()) == rows(con.execute(llm.oracle_sql()[name]).df())


def test_url_filter(spark, folder):
    rules = [(host + path, host, path, verdict) for verdict, host, path in url_filter.RULES]

    def judged(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fits = [r for r in rules if (host == r[1] or host.endswith(f".{r[1]}")) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[0]), default=(None, None, None, "allow"))
        return host, path, best[0], best[3]

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in run(spark, folder, 1).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS)}


def test_edit_counts(spark, folder):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}  # noqa: SIM115
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((str(r["doc_id"]), r["n_tokens_before"]) for r in run(spark, folder, 3).collect())
    assert got == sorted((str(i), len(encoder.encode_ordinary(t or ""))) for i, t, _, _ in ROWS)


def test_shards(spark, folder):
    out = run(spark, folder, 4).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS)
    shards = {}
    for r in out:
        assert 0 <= r["shard"] < 24 and r["law"] == "bytes" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_shards_are_as_heavy_as_they_can_be(spark, tmp_path):
    """Against the slow way: the rows of each side of each cut, in their order, weigh what its shards should, up to a row and the tolerance."""
    from pyspark.sql import functions as F

    from pennyflow.llm import kd_shards

    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), (F.col("id") % 37 * 9 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "en").alias("lang"), (F.col("id") % 5).cast("string").alias("source"))
    for n in (3, 7):
        sums = [r["s"] for r in kd_shards.kd_shards(docs, n).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
        assert len(sums) == n and max(sums) - min(sums) <= 2 * (8 + 2 * 334) + 0.004 * sum(sums) / n


def test_jaccard(spark, folder):
    want = brute_components([(i, t) for i, t, _, _ in ROWS])
    assert sorted(map(str, map(tuple, run(spark, folder, 5).select("doc_id", "n_shingles", "component_id").collect()))) == sorted(map(str, want))


def test_languages(spark, folder):
    for r in run(spark, folder, 6).collect():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und") and (r["lang_pred"] == "und") == (r["doc_id"] in (4, 5, 9))


def test_toxicity(spark, folder):
    for r in run(spark, folder, 7).collect():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_media(spark, folder):
    want = {}
    for i, t, _, _ in ROWS:
        raw = (t or "").encode()
        whole = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        media = flac.encode([whole])[0]
        want.setdefault(str(i), set()).add((len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    out = run(spark, folder, 8).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) in want[str(r["doc_id"])] and r["feature"]


def test_samples_are_read_by_offset(spark):
    from pyspark.sql import functions as F

    payload = bytes(range(256)) * 17
    blocks = flac.decode_column(spark.createDataFrame([(1, flac.encode([payload])[0])], "id long, media binary"))
    for first, n in ((0, 5), (1000, 60), (1023, 2), (1024, 1024), (0, len(payload)), (len(payload) - 3, 3)):
        assert bytes(blocks.select(flac.pcm_range(F.col("blocks"), F.lit(first), F.lit(n)).alias("x")).first()["x"]) == payload[first : first + n]


def test_embeddings(spark, folder):
    rows = embeddings()
    unit = {}
    for i, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v or []], np.float64)
        if label is not None and len(x) and np.isfinite(x).all() and x.any():
            unit[i] = (x / np.linalg.norm(x), label)
    links = {i: {j for j in unit if j != i and unit[j][1] == label and v @ unit[j][0] >= 0.98} for i, (v, label) in unit.items()}
    got = {r["vec_id"]: r for r in run(spark, folder, 9).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        reach, edge = {i}, {i}
        while edge:
            edge = {k for e in edge for k in links.get(e, ())} - reach
            reach |= edge
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, ())), min(reach), min(reach) == i)


def test_bpe(spark, folder):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t, _, _ in ROWS:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        decoded = whole.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, folder, 10).collect()) == sorted(want)


# --- the pipeline


@pytest.mark.parametrize("rows", ["hard", "none"])
def test_stages_on_hard_rows(spark, folder, bare, rows):
    path = folder if rows == "hard" else bare
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumnsRenamed({}).selectExpr("*", "'keep' AS lang_pred", "1 AS size", "2 AS __text", "3 AS predicted", "4 AS copy")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert all((r["lang_pred"], r["size"], r["__text"], r["predicted"], r["copy"], r["Score"]) == ("keep", 1, 2, 3, 4, "extra") for r in kept)
        ids = sorted(str(r["doc_id"]) for r in kept)
        if rows == "none":
            assert not ids
        elif name == "language":
            assert ids == sorted(str(i) for i, *_ in ROWS if i not in (4, 5, 9))
        elif name == "dedup":
            assert ids == sorted(["1", "3", "4", "5", "6", "8", "9", "10", "None"])
    out = corpus_pipeline.encoding_stage(spark, docs, path).collect()
    assert len(out) == (len(ROWS) if rows == "hard" else 0) and all(r["n_tokens"] == len(r["ids"]) for r in out)
