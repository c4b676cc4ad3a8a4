"""Language identification of mixed-language text.

A word's script, by Unicode ranges, narrows the candidates to the languages that were seen to use it.
Each candidate scores the word by the character n-grams that it holds; Viterbi over a text's words,
with a penalty for every switch, labels spans of one language. A text's language is the one that
labels most of its letters, and the score is that share.

Training counts n-grams of labelled rows in Spark tasks, a row of counts for each language and bucket;
prediction is one narrow pass: no shuffle, memory bounded by the model and a chunk of texts. A model takes
a quarter of a megabyte for each language, on the driver and in each task, however many languages there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import add_columns, pieces, table

#: First and last code point of the ranges of scripts (fixed values of the Unicode standard); all other letters are "other".
SCRIPTS = (
    (0x0041, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0A00, 0x0A7F, "gurmukhi"),
    (0x0A80, 0x0AFF, "gujarati"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0C00, 0x0C7F, "telugu"),
    (0x0C80, 0x0CFF, "kannada"),
    (0x0D00, 0x0D7F, "malayalam"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(["other", *(s for _, _, s in SCRIPTS)]))
_LOWS = np.array([a for a, _, _ in SCRIPTS])
_HIGHS = np.array([b for _, b, _ in SCRIPTS])
_IDS = np.array([SCRIPT_NAMES.index(s) for _, _, s in SCRIPTS])

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
#: Labelled rows of each language that training reads, in expectation, chosen by a hash of the id.
TRAIN_ROWS = 4_000
#: What a switch of language costs, in nats, and the weight of a gram in a word's score.
PENALTY, GRAM_WEIGHT = 8.0, 0.5
#: A language uses a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.01
#: Characters and texts worked on together, and words whose scores a task keeps: so many, with so many scores in all.
CHUNK_CHARS, PIECE, KEEP_WORDS, KEEP_SCORES = 1 << 20, 4096, 150_000, 4_000_000
UNKNOWN = "und"
WORDS = regex.compile(r"\p{L}+")
OUTPUTS = {
    "lang_pred": StringType(),
    "score": DoubleType(),
    "n_spans": IntegerType(),
    "spans": ArrayType(StructType([StructField("lang", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])),
}


def script_ids(points: np.ndarray) -> np.ndarray:
    at = np.searchsorted(_LOWS, points, "right") - 1
    return np.where((at >= 0) & (points <= _HIGHS[at]), _IDS[at], 0)


def word_grams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lower-case words: buckets of all grams, the word each belongs to, and each word's script."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    buckets, owners = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolled = rolled[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        if n in GRAMS:
            whole = owner[: len(rolled)] == owner[n - 1 :]
            mixed = (rolled + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(48))[whole].astype(np.int64))
            owners.append(owner[: len(rolled)][whole])
    return np.concatenate(buckets), np.concatenate(owners), script_ids(points[starts + 1].astype(np.int64))


@dataclass(frozen=True)
class Model:
    """Languages in order, log probabilities (bucket, language) and which language uses which script."""

    langs: tuple[str, ...]
    grams: np.ndarray
    uses: np.ndarray
    common: int

    def word_scores(self, words: Sequence[str]) -> np.ndarray:
        """A row for each word: every language's score, far below the others' where the script isn't its."""
        buckets, owners, scripts = word_grams(words)
        out = np.empty((len(words), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owners, self.grams[buckets, k], len(words))
        out *= GRAM_WEIGHT
        out -= out.max(axis=1, keepdims=True)
        allowed = self.uses[scripts]
        narrowed = allowed.any(axis=1)
        out[narrowed] = np.where(allowed[narrowed], out[narrowed], out[narrowed] - 1e4)
        out[~narrowed] = 0
        return out


def words_of(text: str) -> list[str]:
    """The text's runs of letters in lower case, as many as in the text: where lower-casing adds characters, each run is lower-cased by itself."""
    low = text.lower()
    return WORDS.findall(low) if len(low) == len(text) else list(map(str.lower, WORDS.findall(text)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Learns from about ``rows`` rows of each language, whole texts; rows with null text or language are passed over.

    Any number of languages is learned. The counts that reach the driver are at most a number for each
    bucket and language, as is the model itself. Without a labelled row the model has no languages.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool), 0)
    shares = docs.sparkSession.createDataFrame([(name, k, min(1.0, rows / sizes[name])) for k, name in enumerate(langs)], "lang string, place int, share double")
    drawn = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    # As many rows as languages, of which the model holds far more.
    sample = docs.join(F.broadcast(shares), "lang").where(drawn < F.col("share")).select(F.col("place").alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in (p for b in batches for p in pieces(b, [1])):
            for k, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                own = totals.setdefault(k, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                words = words_of(text.as_py())
                for start in range(0, len(words), 1 << 16):
                    part = words[start : start + (1 << 16)]
                    buckets, _, scripts = word_grams(part)
                    own[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(scripts, [len(w) for w in part], len(SCRIPT_NAMES)).astype(np.int64)
        for k, own in totals.items():
            held = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), k), pa.int32()), pa.array(held, pa.int32()), pa.array(own[held])], names=["lang", "bucket", "n"])

    found = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)), np.float32)
    counts[found["lang"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    grams, letters = counts[:, :BUCKETS] + np.float32(0.5), counts[:, BUCKETS:]
    logs = np.log(grams / grams.sum(axis=1, keepdims=True, dtype=np.float64))
    shares = letters / np.maximum(1, letters.sum(axis=1, keepdims=True))
    common = max(range(len(langs)), key=lambda k: (sizes[langs[k]], -k))
    return Model(langs, np.ascontiguousarray(logs.T.astype(np.float32)), (shares >= SCRIPT_SHARE).T, common)


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word. ``scores`` has the texts' words one after the other, ``sizes`` how many each text has.

    All texts advance together, longest first, so a step is one operation for every text that still has words.
    """
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], (np.cumsum(sizes) - sizes)[order]
    n_labels = scores.shape[1]
    kind = np.int16 if n_labels < 1 << 15 else np.int32
    labels, back = np.zeros(len(scores), kind), np.zeros(scores.shape, kind)
    own = np.arange(n_labels, dtype=kind)
    state = np.zeros((len(sizes), n_labels), np.float32)
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1 if len(sizes) else 1), "right")
    for t, n in enumerate(active.tolist()):
        at, now = starts[:n] + t, state[:n]
        if t:
            top = now.argmax(axis=1)
            switched = now[np.arange(n), top] - penalty
            stay = now >= switched[:, None]
            back[at] = np.where(stay, own, top[:, None])
            now = np.where(stay, now, switched[:, None])
        state[:n] = now + scores[at]
    last = state.argmax(axis=1).astype(kind)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        at = starts[:n] + t
        labels[at] = last[:n]
        if t:
            last[:n] = back[at, last[:n]]
    return labels


def identify(
    docs: DataFrame, model: Model, outputs: Iterable[str] = ("lang_pred", "score"), text_col: str = "text", penalty: float = PENALTY, drop: Sequence[str] = ()
) -> DataFrame:
    """Every row of ``docs`` with the wanted ``OUTPUTS`` columns; columns named as one of them, or in ``drop``, go.

    ``lang_pred`` is the language of most letters (the first by name of equals), ``und`` for null
    texts, texts without a letter, or a model without languages; their score is 0 and they have no
    spans. Words in a script that no language uses follow their neighbours. Spans are character
    ranges of the text, end exclusive, in order. Texts of any length are labelled whole, repeated rows
    each; an empty table gives an empty table.
    """
    wanted = list(outputs)
    if unknown := set(wanted) - set(OUTPUTS):
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    held = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "n_spans": pa.int32(), "spans": pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))}

    def start():
        own = held.value
        known: dict[str, int] = {}
        table_: np.ndarray = np.zeros((0, len(own.langs)), np.float32)

        def ids_of(words: list[str]) -> np.ndarray:
            nonlocal table_
            if len(known) > min(KEEP_WORDS, KEEP_SCORES // max(1, len(own.langs))):
                known.clear()
                table_ = table_[:0]
            new = [w for w in dict.fromkeys(words) if w not in known]
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            if new:
                parts = [own.word_scores(new[k : k + (1 << 16)]) for k in range(0, len(new), 1 << 16)]
                table_ = np.concatenate([table_, *parts])
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

        def labelled(texts: list[str]) -> Iterator[dict]:
            per_text = [words_of(t) if own.langs else [] for t in texts]
            sizes = np.fromiter(map(len, per_text), np.int64, len(per_text))
            words = [w for ws in per_text for w in ws]
            letters = np.fromiter(map(len, words), np.int64, len(words))
            labels = viterbi(table_[ids], sizes, penalty) if len(ids := ids_of(words)) else np.zeros(0, np.int64)
            at = 0
            for text, n in zip(texts, sizes.tolist(), strict=True):
                if not n:
                    yield {"lang_pred": UNKNOWN, "score": 0.0, "n_spans": 0, "spans": []}
                    continue
                mine = labels[at : at + n]
                sums = np.bincount(mine, letters[at : at + n], len(own.langs))
                at += n
                best = int(sums.argmax())
                edges = [0, *(np.flatnonzero(mine[1:] != mine[:-1]) + 1).tolist(), n]
                row = {"lang_pred": own.langs[best], "score": float(sums[best] / sums.sum()), "n_spans": len(edges) - 1}
                if "spans" in wanted:
                    places = [m.span() for m in WORDS.finditer(text)]
                    row["spans"] = [{"lang": own.langs[mine[a]], "start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges, edges[1:], strict=False)]
                yield row

        def chunks(texts: list[str | None]) -> Iterator[dict]:
            held_texts, size = [], 0
            for text in texts:
                held_texts.append(text or "")
                size += len(held_texts[-1])
                if size >= CHUNK_CHARS:
                    yield from labelled(held_texts)
                    held_texts, size = [], 0
            if held_texts:
                yield from labelled(held_texts)

        def make(texts: pa.Array) -> list[pa.Array]:
            rows = list(chunks(texts.to_pylist()))
            return [pa.array([r[n] for r in rows], kinds[n]) for n in wanted]

        return make

    return add_columns(docs, [text_col], [StructField(n, OUTPUTS[n]) for n in wanted], start, drop, rows=PIECE)


def held_out(row_id: Column) -> Column:
    """Rows that training leaves out: the crc32 of the id as text leaves 2 when divided by 4. A null id is never held out."""
    return F.coalesce(F.crc32(row_id.cast("string")) % 4 == 2, F.lit(False))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, its share of the letters and its spans, by a model of the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model, ("lang_pred", "score", "n_spans"), drop=["text"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")
