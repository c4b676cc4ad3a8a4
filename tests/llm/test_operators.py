"""The corpus operators against brute force, on hard rows and on the smallest tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pennyflow.llm import bpe, edit_counts, flac, itq, jaccard_join, kd_shards, langid, mixing, toxicity, url_filter

from .conftest import ROWS

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- 1


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://a.example.org/en/12", ("example.org/en/1", "block")), ("http://a.example.org/fr", ("org/", "allow")), ("https://X.COM/de/x?y", ("com/de/", "block")), ("x://org", (None, "allow")),
        ("x://notexample.org/es/", ("org/", "allow")), (None, (None, "allow")), ("no scheme", (None, "allow")), ("", (None, "allow")), ("a://b://com/de/", (None, "allow")),
    ],
)
def test_url_rules(spark, url, want):
    row = url_filter.filter_urls(spark.createDataFrame([(1, url, "mine")], "page_id long, url string, Rule string"), url_filter.RULES).first()
    assert (row["rule"], row["verdict"]) == want


# --- 2


def test_mixing(spark, docs, empty):
    out = mixing.plan_mix(docs).collect()
    assert len(out) == len(ROWS)
    total = sum(r["size"] for r in out)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in out}
    assert all(t <= 3 * s + 1e-9 for t, s in targets.values())
    assert sum(t for t, _ in targets.values()) == pytest.approx(min(total, sum(3 * s for _, s in targets.values())))
    assert all(r["copies"] * r["size"] <= 3 * r["size"] for r in out)
    emitted = mixing.emit_copies(mixing.plan_mix(docs))
    assert emitted.count() == sum(r["copies"] for r in out)
    assert mixing.plan_mix(empty).count() == 0


# --- 3


@pytest.fixture(scope="module")
def encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}  # noqa: SIM115
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab1 '\n\u00e9s!re"), max_size=400), st.lists(st.tuples(st.integers(-2, 420), st.integers(0, 30), st.text(st.sampled_from("ab1 '\ns!"), max_size=12)), max_size=6))
def test_edits_count_as_whole_texts(encoder, text, edits):
    own = edit_counts.counter(*edit_counts.public_vocabulary())
    tree = edit_counts.SegmentTree.of_text(text, own)
    for at, removed, inserted in edits:
        start = min(max(at, 0), len(text))
        want = text[:start] + inserted + text[start + removed :]
        tree, text, _ = tree.edit(text, at, removed, inserted, own)
        tree = edit_counts.SegmentTree.of_row(tree.row())
        assert text == want and tree.tokens == len(encoder.encode_ordinary(text))


def test_edit_frames(spark, docs, empty, encoder):
    vocabulary = edit_counts.public_vocabulary()
    trees = edit_counts.with_trees(docs, vocabulary).withColumn("edits", edit_counts.standard_edits(F.col("doc_id"), F.col("text")))
    out = edit_counts.apply_edits(trees, "edits", vocabulary).collect()
    assert len(out) == len(ROWS) and all(r["n_tokens"] == len(encoder.encode_ordinary(r["text"])) for r in out)
    assert max(r["n_encoded"] for r in out) < 100
    assert edit_counts.with_trees(empty, vocabulary).count() == 0


# --- 4


def test_shards(spark, docs, empty):
    out = kd_shards.kd_shards(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source"), n_shards=5).collect()
    shards = {}
    for r in out:
        shards.setdefault(r["shard"], []).append(r)
    sizes = [sum(r["size"] for r in rows) for rows in shards.values()]
    assert set(shards) == set(range(5)) and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in out)
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in shards.values())
    hard = kd_shards.kd_shards(docs).collect()
    assert sorted(r["size"] for r in hard) == sorted(8 + len((t or "").encode()) for _, t, _, _ in ROWS)
    assert kd_shards.kd_shards(empty).count() == 0
    assert len({r["shard"] for r in kd_shards.kd_shards(docs, target_bytes=10**9).collect()}) == 1


# --- 5


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("classes", [None, ((0.0, 0.0), (2, 3))])
def test_jaccard(spark, docs, empty, monkeypatch, classes):
    rows = [(i, t) for i, t, _, _ in ROWS]
    drawn = np.random.default_rng(5)
    passage = " ".join(f"common{k}" for k in range(60))
    for g in range(12):
        words = [f"w{g}_{k}" for k in range(int(drawn.integers(4, 160)))]
        for c in range(8):
            own = list(words)
            for _ in range(c // 2):
                own[int(drawn.integers(len(own)))] = f"x{drawn.integers(1000)}"
            rows.append((100 + g * 10 + c, " ".join(own) + (" " + passage if g % 2 else "")))
    if classes:
        monkeypatch.setattr(jaccard_join, "CLASS_SHARES", classes[0])
        monkeypatch.setattr(jaccard_join, "CLASS_LEAST", classes[1])
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(str, (tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()))) == sorted(map(str, brute_components(rows)))
    if classes is None:
        assert jaccard_join.jaccard_join(empty).count() == 0
        kept = sorted(r["doc_id"] for r in jaccard_join.keep_one(docs).where("doc_id IS NOT NULL").collect())
        assert kept == [1, 3, 4, 5, 6, 8, 9, 10]


@pytest.mark.parametrize("percent", [0, 49, 101])
def test_jaccard_refuses_what_it_would_lose(docs, percent):
    with pytest.raises(ValueError, match="percent"):
        jaccard_join.jaccard_join(docs, percent=percent)


def test_keep_one_of_repeated_ids(spark):
    a, b = (" ".join(f"{w}{k}" for k in range(40)) for w in "ab")
    rows = [(1, a), (2, b), (2, a + " more"), (3, b + " more"), (5, "alone here"), (5, "other text"), (5, "other text"), (6, ""), (6, None)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(1, a), (2, b), (5, "alone here"), (5, "other text"), (6, ""), (6, None)]))


# --- 6


@pytest.mark.parametrize(("size_a", "size_b"), [(400, 450), (500, 530), (600, 700), (3, 600)])
def test_sketches_bound_the_difference(spark, size_a, size_b):
    tokens = np.random.default_rng(size_a).integers(0, 1 << 63, size_a + size_b, np.uint64)
    sets = [np.unique(tokens[:size_a]), np.unique(tokens[20 : 20 + size_b])]
    row = [x for s in sets for x in (jaccard_join.sketches(s)[0].tolist(), len(s))]
    frame = spark.createDataFrame([row], "a array<long>, n long, b array<long>, m long")
    words = [jaccard_join.bit_words(F.col(c)) for c in "ab"]
    found = frame.select(jaccard_join.bits_differ(*words, F.col("n"), F.col("m"))).first()[0]
    assert 0 < found <= len(np.setxor1d(*sets))


def test_languages(spark, docs, empty):
    all_docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(all_docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(all_docs, model).where(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    hard = langid.identify(docs, model, ("lang_pred", "score", "n_spans", "spans")).collect()
    assert len(hard) == len(ROWS) and all(0 <= r["score"] <= 1 for r in hard)
    assert {r["doc_id"] for r in hard if r["lang_pred"] == "und"} == {4, 5, 9}
    assert all(s["start"] < s["end"] for r in hard for s in r["spans"])
    assert langid.identify(empty, model).count() == 0
    none = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    drawn = np.random.default_rng(1)
    for n in (1, 2, 5):
        scores = drawn.normal(size=(n, 3)).astype(np.float32)
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        value = lambda p: scores[np.arange(n), p].sum() - 0.7 * (np.diff(p) != 0).sum()  # noqa: B023, E731
        assert value(langid.viterbi(scores, np.array([n]), 0.7)) == pytest.approx(max(map(value, paths)), abs=1e-5)


def test_mixed_language_spans(spark):
    all_docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["lang"]: r["text"] for r in all_docs.where("length(text) BETWEEN 300 AND 3000").collect()}
    a, b = texts["en"][:300], texts["fr"][:300]
    row = langid.identify(spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string"), langid.train(all_docs), ("spans",)).first()
    assert {"en", "fr"} <= {s["lang"] for s in row["spans"]} and len(row["spans"]) <= 5


# --- 7


def test_toxicity(spark, docs, empty):
    clean, bad = "a calm day by the river. we walked home slowly", "you are a vile grumblewort"
    rows = [(k, f"{clean} number{k}. " + (bad if k % 3 == 0 else "it rained") + ". the end") for k in range(240)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)], "doc_id long, toxic int")
    model = toxicity.train(train, labels.where(~toxicity.held_out(F.col("doc_id"))))
    out = toxicity.score_texts(train, model, ("score", "predicted", "worst_start", "worst_end", "offending")).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in out)
    assert all("grumblewort" in r["text"][r["worst_start"] : r["worst_end"]] and len(r["offending"]) == 1 for r in out if r["predicted"])
    hard = toxicity.score_texts(docs, model).collect()
    assert len(hard) == len(ROWS) and all(0 <= r["score"] <= 1 for r in hard)
    assert toxicity.score_texts(empty, model).count() == 0
    assert {r["predicted"] for r in toxicity.score_texts(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0}


def test_toxic_part_far_into_an_unspaced_run(spark, monkeypatch):
    runs = [f"{'qx' * 250}grumblewort{'jk' * 20}", f"{'qx' * 250}calmriver{'jk' * 20}"]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)], "doc_id long, toxic int")
    spaced = spark.createDataFrame([(k, f"a calm day number{k}. " + ("you vile grumblewort" if k % 3 == 0 else "it rained")) for k in range(240)], "doc_id long, text string")
    unspaced = spark.createDataFrame([(k, f"{'qx' * 250}n{k}_" + ("grumblewort" if k % 3 == 0 else "calmriver") + f"_{k}") for k in range(240)], "doc_id long, text string")
    texts = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    for train in (spaced, unspaced):
        model = toxicity.train(train, labels)
        assert [r["predicted"] for r in toxicity.score_texts(texts, model).orderBy("doc_id").collect()] == [1, 0]
    monkeypatch.setattr(toxicity, "LONG_CHARS", 1_000)  # the counts are the same in pieces
    assert toxicity.train(unspaced, labels).weights.keys() == model.weights.keys()
    known = toxicity.Known(model.weights)
    assert list(known.sentences(runs[0])) and not known


# --- 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5))
def test_flac_round_trip(payloads):
    for payload, blocks in zip(payloads, flac.decode(flac.encode(payloads)), strict=True):
        assert b"".join((b[0] + 128).astype(np.uint8).tobytes() for _, b in blocks) == payload
        assert [f for f, _ in blocks] == list(range(0, len(payload), flac.BLOCK))


def test_flac_frames(spark, docs, empty):
    media = flac.encode_column(docs, "text")
    out = flac.decode_column(media, "media", ("blocks", "error", "payload_sha256", "tail_crc32")).collect()
    for r in out:
        raw = flac.padded(r["text"])
        assert r["error"] is None and r["payload_sha256"] == hashlib.sha256(raw).hexdigest() and r["tail_crc32"] == zlib.crc32(raw[-64:])
        assert b"".join(bytes(b["pcm"]) for b in r["blocks"]) == raw
    broken = bytearray(flac.encode([b"some text " * 200])[0])
    broken[-9] ^= 4
    rows = spark.createDataFrame([(1, bytes(broken)), (2, b"nothing"), (3, None), (4, flac.encode([b"x" * 64])[0])], "id long, media binary")
    assert [r["error"] is None for r in flac.decode_column(rows, "media", ("error",)).orderBy("id").collect()] == [False, False, False, True]
    assert flac.encode_column(empty, "text").count() == 0


def with_mark(payload, at, after, stream):
    """The payload with a frame's fitting checksum and then ``after`` as its stored bytes from sample ``at`` of its first, verbatim frame on."""
    start = flac.read_info(stream)[0]
    body = flac.read_frame_head(stream, start, flac.BLOCK, 8)[0] + 1
    check = flac.crc16(np.frombuffer(stream[start : body + at], np.uint8))
    return payload[:at] + bytes(b ^ 128 for b in check.to_bytes(2, "big") + after) + payload[at + 2 + len(after) :]


@pytest.mark.parametrize("number", [None, 0, 7])
def test_flac_marks_within_a_frame(number):
    payload = np.random.default_rng(8).integers(0, 256, 3 * flac.BLOCK, np.uint8).tobytes()
    head = b"\xff\xf8\xa0\x02" + bytes([number or 0])
    after = b"\xff\xf8\x00\x00" if number is None else head + bytes([flac.crc8(head)])
    marked = with_mark(payload, 300, after, flac.encode([payload])[0])
    stream = flac.encode([marked])[0]
    start = flac.read_info(stream)[0]
    at = stream.index(after, start + 100)
    assert flac.crc16(np.frombuffer(stream[start : at - 2], np.uint8)) == int.from_bytes(stream[at - 2 : at], "big")
    assert b"".join((b[0] + 128).astype(np.uint8).tobytes() for _, b in flac.decode([stream])[0]) == marked


def test_flac_lost_frames_leave_the_others():
    payload = np.random.default_rng(9).integers(0, 256, 4 * flac.BLOCK, np.uint8).tobytes()
    stream = flac.encode([payload])[0]
    frames = flac.find_frames(stream, 0)[0]
    unknown = stream[:21] + bytes([stream[21] & 0xF0]) + bytes(20) + stream[42:]
    lacking = unknown[: frames[1].at] + unknown[frames[1].end :]
    assert [first for first, _ in flac.decode([lacking])[0]] == [0, 2 * flac.BLOCK, 3 * flac.BLOCK]


def test_flac_query_names_faults(spark):
    out = flac.op8_flac(spark, SF)
    assert "error" in out.columns and out.where("error IS NOT NULL OR payload_sha256 IS NULL").count() == 0


# --- 9


def test_embeddings(spark):
    drawn = np.random.default_rng(3)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(30):
            centre = drawn.normal(size=16)
            for copy in range(int(drawn.integers(1, 6))):
                rows.append((k, (centre + drawn.normal(size=16) * 0.02 * copy).tolist(), label))
                k += 1
    rows += [(k, None, 0), (k + 1, [0.0] * 16, 0), (k + 2, [float("nan")] * 16, 0), (k + 3, [None] * 16, 0), (k + 4, [], 0), (k + 5, rows[0][1], 0), (k + 6, rows[0][1][:8], 0)]
    got = by_id(itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id")
    valid = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows[:-7] if lab is not None] + [(k + 5, np.array(rows[0][1]) / np.linalg.norm(rows[0][1]), 0)]
    found = missed = 0
    for i, v, lab in valid:
        links = sum(j != i and lab == other and v @ w >= 0.98 for j, w, other in valid)
        assert got[i]["n_links"] <= links
        found, missed = found + got[i]["n_links"], missed + links - got[i]["n_links"]
    assert found >= 0.95 * (found + missed) > 0
    assert all(got[j]["n_links"] == 0 and got[j]["component_id"] == j for j in (k, k + 1, k + 2, k + 3, k + 4, k + 6))
    assert got[k + 5]["component_id"] == 0 and not got[k + 5]["kept"]
    assert len(got) == len(rows)
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_blocks_of_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK_ROWS", 7)
    drawn = np.random.default_rng(4)
    centre = drawn.normal(size=24)
    rows = [(i, (centre + drawn.normal(size=24) * 0.01).tolist(), 1) for i in range(60)]
    out = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r["n_links"] == 59 and r["component_id"] == 0 for r in out)


# --- 10


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.public_path())
    out = bpe.bpe(docs, bpe.public_path(), ("n_tokens", "ids", "decoded")).collect()
    assert len(out) == len(ROWS)
    for r in out:
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == whole.decode(ids, skip_special_tokens=False)
    assert bpe.bpe(empty, bpe.public_path()).count() == 0


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(r["n_tokens"] == len(r["ids"]) for r in out)
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
