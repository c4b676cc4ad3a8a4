"""Decoders and models against streams of other encoders and against plain, slow computations."""

import hashlib
import zlib
from collections import Counter
from math import exp, log, prod

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pennyflow.llm import flac, kd_shards, langid, mixing, toxicity

#: The three example streams that the format's specification (RFC 9639, appendix D) prints, with their samples by channel.
PUBLISHED = (
    ("664c6143800000221000100000000f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0ffff869180000bf0358fd03128baa9a", [[25588], [10416]]),
    (
        "664c61430000002200100010000017000044 0ac442f000000013d5b0564975e98b8d8b930422757b810303000012000000000000000000000000000000000010 0400003a200000007265666572656e6365206c6962464c414320312e332e33203230313930383034010000000e000000"
        "5449544c453dd7a9d79cd795d79d81000006000000000000fff86998000f9912086701623d1442998f5df70d6fe00c17caeb21000ee7a77a24a1590c1217b603097b784faa9a33d285e070ad5b1b4851b4010d99d2cd1a68f1e6b810fff869180102a402c382c40bc14a03ee48dd03b67c1330",
        [
            [10372, 18041, 14942, 17876, 15627, 17899, 16242, 18077, 16824, 18263, 17295, -14418, -15201, -14508, -15195, -14818, -15486, -15349, -16054],
            [6070, 10545, 8743, 10449, 9143, 10463, 9502, 10569, 9840, 10680, 10113, -8428, -8895, -8476, -8896, -8653, -9072, -8958, -9410],
        ],
    ),
    (
        "664c6143800000221000100000001f00001f07d0007000000018f8f9e396f5cbcfc6dc807f9977906b32fff868020017e944004f6f313d1047d227cb6d090831452bdc2822228057a3",
        [[0, 79, 111, 78, 8, -61, -90, -68, -13, 42, 67, 53, 13, -27, -46, -38, -12, 14, 24, 19, 6, -4, -5, 0]],
    ),
)


@pytest.mark.parametrize("k", range(3))
def test_published_streams(k):
    """Stereo with sides, wasted bits, Rice partitions, fixed and linear predictors, a frame of another size; all checksums and the MD5 are verified on the way."""
    raw, want = PUBLISHED[k]
    blocks = flac.decode([bytes.fromhex(raw.replace(" ", ""))])[0]
    assert np.concatenate([b for _, b in blocks], axis=1).tolist() == want
    assert [first for first, _ in blocks] == np.cumsum([0, *(b.shape[1] for _, b in blocks[:-1])]).tolist()


def slow_crc(bits: str, poly: int, size: int) -> str:
    value = 0
    for b in bits:
        top = (value >> (size - 1)) ^ int(b)
        value = ((value << 1) & ((1 << size) - 1)) ^ (poly if top else 0)
    return format(value, f"0{size}b")


def rice(x: int, k: int) -> str:
    u = 2 * x if x >= 0 else -2 * x - 1
    return "0" * (u >> k) + "1" + (format(u & ((1 << k) - 1), f"0{k}b") if k else "")


def signed(x: int, size: int) -> str:
    return format(x & ((1 << size) - 1), f"0{size}b")


def written(subframes: list[str], mode: int, n: int) -> bytes:
    """A stream of one frame with these subframes of 8-bit samples, bit by bit."""
    head = "11111111" "11111000" + "0110" + "0000" + format(mode, "04b") + "001" + "0" + "00000000" + format(n - 1, "08b")
    frame = head + slow_crc(head, 0x07, 8) + "".join(subframes)
    frame += "0" * (-len(frame) % 8)
    frame += slow_crc(frame, 0x8005, 16)
    info = format(n, "016b") * 2 + "0" * 48 + format(8000, "020b") + format(0 if mode == 0 else 1, "03b") + format(7, "05b") + format(n, "036b") + "0" * 128
    bits = "".join(format(b, "08b") for b in b"fLaC\x80\x00\x00\x22") + info + frame
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_escapes_partitions_and_wasted_bits():
    drawn = np.random.default_rng(2)
    residuals = [*drawn.integers(-3, 4, 7).tolist(), *drawn.integers(-8, 8, 8).tolist()]
    warm, samples = 9, [9]
    for r in residuals:
        samples.append(samples[-1] + r)
    first, second = residuals[:7], residuals[7:]
    own = "0" + "001001" + "1" + "01" + signed(warm, 6) + "00" + "0001" + "0001" + "".join(rice(r, 1) for r in first) + "1111" + format(5, "05b") + "".join(signed(r, 5) for r in second)
    got = flac.decode([written([own], 0, 16)])[0][0][1]
    assert got.tolist() == [[4 * s for s in samples]]  # two wasted bits


@pytest.mark.parametrize("mode", [1, 8, 9, 10])
def test_stereo_modes(mode):
    left, right = [5, -7, 100, 3, 0, -1], [4, -9, 90, 5, 1, -1]
    pairs = {1: (left, right, 0, 0), 8: (left, [a - b for a, b in zip(left, right, strict=True)], 0, 1), 9: ([a - b for a, b in zip(left, right, strict=True)], right, 1, 0), 10: ([(a + b) >> 1 for a, b in zip(left, right, strict=True)], [a - b for a, b in zip(left, right, strict=True)], 0, 1)}
    a, b, more_a, more_b = pairs[mode]
    verbatim = lambda xs, more: "0" + "000001" + "0" + "".join(signed(x, 8 + more) for x in xs)
    got = flac.decode([written([verbatim(a, more_a), verbatim(b, more_b)], mode, 6)])[0][0][1]
    assert got.tolist() == [left, right]


@pytest.mark.parametrize("bits", [8, 16, 24])
def test_samples_are_as_wide_as_the_stream_says(spark, bits):
    """A loud block and a silent one: their bytes follow the stream's bits, not the values."""
    code, width = {8: "001", 16: "100", 24: "110"}[bits], bits // 8
    loud, quiet = [(1 << bits - 1) - 1 - 3 * k for k in range(16)], [0, -1, 1, 0] * 4
    stream = "".join(format(b, "08b") for b in b"fLaC\x80\x00\x00\x22") + format(16, "016b") * 2 + "0" * 48 + format(8000, "020b") + "000" + format(bits - 1, "05b") + format(32, "036b") + "0" * 128
    for number, samples in enumerate((loud, quiet)):
        head = "11111111" "11111000" + "0110" + "0000" + "0000" + code + "0" + format(number, "08b") + format(15, "08b")
        frame = head + slow_crc(head, 0x07, 8) + "0" + "000001" + "0" + "".join(signed(x, bits) for x in samples)
        stream += frame + slow_crc(frame, 0x8005, 16)
    media = int(stream, 2).to_bytes(len(stream) // 8, "big")
    want = b"".join((x + 128).to_bytes(1, "little") if bits == 8 else x.to_bytes(width, "little", signed=True) for x in loud + quiet)
    row = flac.decode_column(spark.createDataFrame([(1, media)], "id long, media binary"), outputs=("blocks", "error", "payload_sha256", "tail_crc32", "samples"))
    got = row.select("*", flac.pcm_bytes(F.col("blocks")).alias("all"), flac.pcm_range(F.col("blocks"), F.lit(14), F.lit(5)).alias("some")).first()
    assert got["error"] is None and got["samples"] == 32 and [len(b["pcm"]) for b in got["blocks"]] == [16 * width] * 2
    assert bytes(got["all"]) == want and bytes(got["some"]) == want[14 * width : 19 * width]
    assert got["payload_sha256"] == hashlib.sha256(want).hexdigest() and got["tail_crc32"] == zlib.crc32(want[-64:])


# --- toxicity


def slow_likelihood(at, bags, labels, weight):
    """Minus the weighted log likelihood, by the definition."""
    total = 0.0
    for sentences, label in zip(bags, labels, strict=True):
        left = prod(1 - 1 / (1 + exp(-(at[-2] + sum(at[k] for k in s)))) for s in sentences) * (1 - 1 / (1 + exp(-at[-1])))
        total -= weight[label] * (log(1 - left) if label else log(left))
    return total


def test_gradient_is_the_slope_of_the_likelihood():
    drawn = np.random.default_rng(6)
    bags = [[sorted(set(drawn.integers(0, 5, 3).tolist())) for _ in range(int(drawn.integers(0, 4)))] for _ in range(12)]
    labels = [int(k % 3 == 0) for k in range(12)]
    weight, at = {0: 1.5, 1: 2.0}, drawn.normal(size=7)
    batch = pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.list_(pa.int32()))), pa.array(labels, pa.int32())], names=["bags", "label"])
    got = np.frombuffer(next(iter(toxicity._gradient(at, weight)(iter([batch])))).column("g")[0].as_py())
    for k in range(7):
        step = np.eye(7)[k] * 1e-5
        assert got[k] == pytest.approx((slow_likelihood(at + step, bags, labels, weight) - slow_likelihood(at - step, bags, labels, weight)) / 2e-5, rel=1e-4, abs=1e-6)
    assert got[-1] == pytest.approx(sum(weight[x] for x in labels))


def test_scores_are_noisy_ors(spark):
    model = toxicity.Model({"bad": 3.0, "awful": 1.0, "~awfu": 0.5, "~wful": 0.25}, -2.0)
    texts = ["bad day. awful day. fine.", "unlawful act", "nothing", "", None, "bad awful bad"]
    known = {"bad": ["bad"], "awful": ["awful", "~awfu", "~wful"], "unlawful": ["~awfu", "~wful"]}

    def slow(text):
        left, held = 1.0, False
        for sentence in (text or "").split("."):
            marks = {m for w in sentence.split() for m in known.get(w, ())}
            if marks:
                held, left = True, left * (1 - 1 / (1 + exp(2.0 - sum(model.weights[m] for m in marks))))
        return 1 - left if held else 0.0

    rows = toxicity.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["score"] for r in rows] == pytest.approx([slow(t) for t in texts], abs=1e-12)


# --- languages


def test_word_scores_against_plain_counts(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the hat", "en"), ("der hund und die katze", "de"), ("это кот", "ru"), ("that other cat", "en"), (None, "en"), ("x", None)])]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ("de", "en", "ru")

    def buckets(word):
        return langid.word_grams([word])[0].tolist()

    counts = {lang: Counter(b for _, t, own in rows if t and own == lang for w in langid.words_of(t) for b in buckets(w)) for lang in model.langs}
    sizes = {lang: sum(c.values()) + 0.5 * langid.BUCKETS for lang, c in counts.items()}
    for word in ("cat", "und", "zebra"):
        plain = np.array([langid.GRAM_WEIGHT * sum(log((counts[lang][b] + 0.5) / sizes[lang]) for b in buckets(word)) for lang in ("de", "en")])
        got = model.word_scores([word])[0]
        assert got[:2] - got[:2].max() == pytest.approx(plain - plain.max(), abs=1e-2)
        assert got[2] < got[:2].min() - 1_000  # Latin letters leave no place for a language that doesn't use them
    assert model.word_scores(["кот"])[0].argmax() == 2


def test_many_languages(spark):
    rows = [(k, f"w{chr(97 + k % 26)}{chr(97 + k // 26)}q hello", f"l{k:03d}") for k in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs, langid.train(docs)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 200


def test_spans_where_small_letters_are_longer(spark):
    text = "İstanbul İzmir the cat and the hat"
    docs = spark.createDataFrame([(1, text, "en"), (2, "the cat sat", "en"), (3, "der hund", "de")], "doc_id long, text string, lang string")
    row = langid.identify(docs, langid.train(docs), ("spans", "n_spans")).where("doc_id = 1").first()
    assert len(row["spans"]) == row["n_spans"] and row["spans"][0]["start"] == 0 and row["spans"][-1]["end"] == len(text)


# --- mixing


def test_targets_against_filling_by_hand(spark):
    drawn = np.random.default_rng(3)
    sizes = [(None if k == 6 else f"s{k}", int(x)) for k, x in enumerate(drawn.integers(0, 900, 7))] + [("zero", 0)]
    names = sorted([s for s, _ in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full = {s: 3 * n for s, n in sizes}
    target, open_, rest = {}, set(names), sum(n for _, n in sizes)
    while True:  # sources that would be above their cap stop there, and the others share what is left
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > full[s]}
        if not over:
            break
        for s in over:
            target[s] = full[s]
            rest -= full[s]
        open_ -= over
    target |= share
    out = mixing.source_targets(spark.createDataFrame(sizes, "source string, size long").repartition(5)).collect()
    assert {r["source"]: r["target"] for r in out} == pytest.approx(target)
    assert {r["source"]: r["weight"] for r in out} == weight


def test_mixing_keeps_odd_names(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, 2, 3), (1, "a b", "s", 1, 2, 3), (None, None, None, 4, 5, 6)], "doc_id long, text string, source string, __mine int, _words int, Size int")
    out = mixing.plan_mix(docs)
    assert {"__mine", "_words"} <= set(out.columns) and sorted(r["__mine"] for r in out.collect()) == [1, 1, 4]
    assert out.where(F.col("doc_id") == 1).select("copies").distinct().count() == 1


def test_two_digests_alike(tmp_path):
    from pennyflow.llm import url_filter

    (tmp_path / "d").write_bytes(b"".join(url_filter.digest_bytes([("block", "a", "/"), ("allow", "b", "/")])))
    digests = url_filter.DigestArray(str(tmp_path / "d"))
    import xxhash

    shared = xxhash.xxh64_intdigest("b/")
    digests.digests = np.full(2, shared, np.uint64)
    assert digests.string(int(digests.find(["b/"])[0])) == "b/"  # found among rules of one digest
    digests.digests = np.full(2, xxhash.xxh64_intdigest("c/"), np.uint64)
    assert digests.find(["c/"])[0] == -1  # the digest is there, the string isn't


# --- k-d tree


def slow_shards(rows, n_shards):
    """The tree built node by node over sorted lists: rows are (key of the row, size, tie, dimensions)."""
    dims = range(len(rows[0][3]))
    spans = [max(1, max(r[3][d] for r in rows) - min(r[3][d] for r in rows)) for d in dims]
    out = {}

    def split(own, first, n):
        if n == 1 or not own:
            out.update({r[0]: first for r in own})
            return
        widths = [(max(r[3][d] for r in own) - min(r[3][d] for r in own)) / spans[d] for d in dims]
        d = widths.index(max(widths))
        key = lambda r: (r[3][d] << 47) + r[2]
        half, total = n // 2, sum(r[1] for r in own)
        want, before, cut = total * half / n, 0, None
        for k in sorted({key(r) for r in own}):
            after = before + sum(r[1] for r in own if key(r) == k)
            if after >= want:
                cut = k + 1 if after - want <= want - before else k
                break
            before = after
        split([r for r in own if key(r) < cut], first, half)
        split([r for r in own if key(r) >= cut], first + half, n - half)

    split(rows, 0, n_shards)
    return out


@pytest.mark.parametrize("n_shards", [1, 2, 7, 24])
def test_shards_of_a_tree_built_slowly(spark, docs, monkeypatch, n_shards):
    """Without the tolerance every cut is the weighted quantile of the widest dimension, and every row in the shard of the slow tree."""
    monkeypatch.setattr(kd_shards, "TOLERANCE", 0.0)
    more = spark.range(500).select(
        F.col("id") + 100, F.repeat(F.lit("word "), (F.col("id") % 41 * (F.col("id") % 3)).cast("int")), F.when(F.col("id") % 3 > 0, F.concat(F.lit("l"), (F.col("id") % 4).cast("string"))), (F.col("id") % 7).cast("string"), F.lit("x")
    )
    table = docs.union(more)
    measured = kd_shards.measured(table).collect()
    rows = [((r["id"], r["text_crc32"], r["size"]), r["size"], r["tie"], (r["d0"], r["d1"], r["d2"])) for r in measured]
    want = slow_shards(rows, n_shards)
    got = {(r["doc_id"], r["text_crc32"], r["size"]): r["shard"] for r in kd_shards.kd_shards(table, n_shards).collect()}
    assert got == want
