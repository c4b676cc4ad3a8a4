"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the words and word parts it
holds, a document's is the noisy-or of its sentences': one toxic sentence is enough. Only documents
have labels; training follows the gradient of their likelihood down to the sentences, so that
afterwards each sentence has a score of its own and the offending ones are known. In training, a leak
stands for labels that no sentence explains; it has no part in scores.

Training reads a bounded sample of the labelled rows (``TRAIN_ROWS`` of each class, in expectation,
chosen by a hash of the id). Each step is a Spark job over the sample's word numbers that sends one
gradient from each task to the driver. Scoring is one narrow pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import add_columns, pieces, stored, table

#: Labelled rows of each class that training reads, in expectation.
TRAIN_ROWS = 6_000
#: Words and word parts that the model weighs, at most: those that sentences of toxic documents hold at least
#: LEAST_RATIO times as often, by at least LEAST_Z standard errors, the clearest first.
VOCABULARY, LEAST_RATIO, LEAST_Z, LEAST_SENTENCES = 4_000, 5.0, 3.3, 4
#: Lengths of word parts.
PARTS = (4, 5, 6)
#: Words kept by a task; longer words than KEEP_CHARS are not kept. Counts are handed on when they hold LONG_CHARS of such words.
KEEP_WORDS, KEEP_CHARS, LONG_CHARS = 150_000, 40, 200_000
STEPS, RATE, L2, TRAIN_TASKS = 25, 0.4, 1e-4, 8
#: A sentence is offending from this probability on.
OFFENDING = 0.5
SENTENCE = re.compile(r"[^.!?\n。！？]+")
WORD = re.compile(r"\w+")
OUTPUTS = {
    "score": DoubleType(),
    "predicted": IntegerType(),
    "n_offending": IntegerType(),
    "worst_start": IntegerType(),
    "worst_end": IntegerType(),
    "offending": ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())])),
}


def features(word: str) -> Iterator[str]:
    """The word, and its parts from end to end, marked so as not to be taken for words; repeated parts come again."""
    yield word
    for n in PARTS:
        for k in range(len(word) - n + 1):
            yield f"~{word[k : k + n]}"


class Known(dict):
    """Word to the known ones of its features; holds a bounded number of words."""

    def __init__(self, known: dict) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> frozenset:
        found = frozenset(f for f in features(word) if f in self.known)
        if len(word) <= KEEP_CHARS:
            if len(self) >= KEEP_WORDS:
                self.clear()
            self[word] = found
        return found

    def sentences(self, text: str) -> Iterator[tuple[int, int, set[str]]]:
        """Start, end and known features of the sentences that hold any."""
        for m in SENTENCE.finditer(text):
            if found := set().union(*map(self.__getitem__, WORD.findall(m.group().lower()))):
                yield m.start(), m.end(), found


@dataclass(frozen=True)
class Model:
    """The weight of each known word or part, and what every sentence that holds one starts from; the others' probability is 0."""

    weights: dict[str, float]
    bias: float


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def noisy_or(logits: np.ndarray) -> float:
    """1 minus the product of what each sentence leaves."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> tuple[DataFrame, dict[int, float]]:
    """text and label (0 or 1) of the drawn rows, and each class's share that was drawn.

    A document labelled more than once takes its largest label; null ids and labels are passed over.
    """
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = {k: min(1.0, rows / n) for k, n in sizes.items()}
    chosen = F.pmod(F.xxhash64("id", F.lit("toxicity sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rate = F.when(F.col("label") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0)))
    drawn = known.where(chosen < rate)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    # Two classes of TRAIN_ROWS at most, in expectation: an id and a number each.
    joined = texts.join(F.broadcast(drawn), "id").select("text", "label")
    return stored(joined.repartition(TRAIN_TASKS)), share


def choose_words(sample: DataFrame) -> list[str]:
    """The words and parts that mark toxic documents' sentences, the clearest first. Equal texts count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = (Counter(), Counter()), 0
        for batch in (p for b in batches for p in pieces(b, [0])):
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                for m in SENTENCE.finditer(text.as_py()):
                    words = set(WORD.findall(m.group().lower()))
                    held[label].update(words)
                    held[label][""] += 1
                    long += sum(len(w) for w in words if len(w) > KEEP_CHARS)
                if long >= LONG_CHARS:
                    yield counted(held)
                    held, long = (Counter(), Counter()), 0
        yield counted(held)

    def counted(held: tuple[Counter, Counter]) -> pa.RecordBatch:
        parts = (Counter(), Counter())
        for own, out in zip(held, parts, strict=True):
            for word, n in own.items():
                for f in set(features(word)) if word else ("",):
                    out[f] += n
        words = list(parts[0].keys() | parts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([h[w] for w in words], pa.int64()) for h in parts)], names=["word", "clean", "toxic"])

    sums = sample.dropDuplicates(["text"]).mapInArrow(count, "word string, clean long, toxic long")
    sums = sums.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = stored(sums.where(F.col("clean") + F.col("toxic") >= LEAST_SENTENCES))
    total = sums.where("word = ''").first()
    if total is None or not total["clean"] or not total["toxic"]:
        return []
    ratio = (F.col("toxic") + 0.5) / (total["toxic"] + 1.0) / ((F.col("clean") + 0.5) / (total["clean"] + 1.0))
    z = F.log(ratio) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = sums.where("word <> ''").withColumn("z", z).where((F.col("z") >= LEAST_Z) & (ratio >= LEAST_RATIO))
    return [r["word"] for r in found.orderBy(F.desc("z"), "word").limit(VOCABULARY).collect()]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS
) -> Model:
    """The model of the labelled documents; without both classes, one that finds nothing toxic."""
    sample, share = sample_of(docs, labels, id_col, text_col, label_col, rows)
    words = choose_words(sample)
    if not words:
        return Model({}, -8.0)
    numbers = sample.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words)})

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(numbers.value)
        for batch in (p for b in batches for p in pieces(b, [0])):
            out = [[sorted(known.known[f] for f in found) for _, _, found in known.sentences(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.list_(pa.int32()))), batch.column("label")], names=["bags", "label"])

    held = stored(sample.mapInArrow(bags, "bags array<array<int>>, label int"))
    weight = {k: 1 / share[k] for k in share}
    at = np.concatenate([np.zeros(len(words)), [-2.0, -3.0]])  # weights, bias, leak
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, STEPS + 1):
        total = np.sum([np.frombuffer(r["g"]) for r in held.mapInArrow(_gradient(at, weight), "g binary").collect()], axis=0)
        slope = total[:-1] / max(1.0, total[-1])
        slope[:-2] += L2 * at[:-2]
        first, second = 0.8 * first + 0.2 * slope, 0.95 * second + 0.05 * slope**2
        at = at - RATE * (first / (1 - 0.8**step)) / (np.sqrt(second / (1 - 0.95**step)) + 1e-6)
    return Model({w: float(x) for w, x in zip(words, at[:-2], strict=True)}, float(at[-2]))


def _gradient(at: np.ndarray, weight: dict[int, float]):
    """Each task's sum of the documents' gradients, and after it the sum of their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(at) + 1)
        for batch in batches:
            for bags, label in zip(batch.column("bags").to_pylist(), batch.column("label").to_pylist(), strict=True):
                total[-1] += weight[label]
                sizes = [len(b) for b in bags]
                flat = np.concatenate([*bags, []]).astype(np.int64)
                sums = np.add.reduceat(at[flat], np.cumsum([0, *sizes[:-1]])) if bags else np.zeros(0)
                logits = np.append(at[-2] + sums, at[-1])
                each = sigmoid(logits)
                whole = noisy_or(logits)
                slope = weight[label] * (each if label == 0 else -each * (1 - whole) / max(whole, 1e-9))
                np.add.at(total, flat, np.repeat(slope[:-1], sizes))
                total[-3] += slope[:-1].sum()
                total[-2] += slope[-1]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    return run


def score_texts(docs: DataFrame, model: Model, outputs: Iterable[str] = ("score", "predicted"), text_col: str = "text", drop: Sequence[str] = ()) -> DataFrame:
    """Every row of ``docs`` with the wanted ``OUTPUTS`` columns; columns named as one of them, or in ``drop``, go.

    ``score`` is the noisy-or of the sentences; texts that are null, empty or hold no known word score
    0. ``predicted`` is 1 from 0.5 on. ``offending`` lists the sentences whose own probability is at
    least ``OFFENDING``, as character ranges, end exclusive; worst_start and worst_end are those of the
    likeliest sentence (the first of equals), null if no sentence holds a known word. Texts of any length
    are scored whole, repeated rows each; an empty table gives an empty table.
    """
    wanted = list(outputs)
    if unknown := set(wanted) - set(OUTPUTS):
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    held = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"score": pa.float64(), "offending": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))}

    def start():
        own = held.value
        known = Known(own.weights)

        def make(texts: pa.Array) -> list[pa.Array]:
            rows = []
            for text in texts:
                found = list(known.sentences(text.as_py() or ""))
                logits = np.array([own.bias + sum(map(own.weights.__getitem__, sorted(f))) for _, _, f in found])
                score = noisy_or(logits) if found else 0.0
                row = {"score": score, "predicted": int(score >= 0.5), "worst_start": None, "worst_end": None, "n_offending": 0, "offending": []}
                if found:
                    each = sigmoid(logits)
                    row["worst_start"], row["worst_end"], _ = found[int(each.argmax())]
                    row["offending"] = [{"start": a, "end": b, "score": float(p)} for (a, b, _), p in zip(found, each, strict=True) if p >= OFFENDING]
                    row["n_offending"] = len(row["offending"])
                rows.append(row)
            return [pa.array([r[n] for r in rows], kinds.get(n, pa.int32())) for n in wanted]

        return make

    return add_columns(docs, [text_col], [StructField(n, OUTPUTS[n]) for n in wanted], start, drop)


def held_out(row_id: Column) -> Column:
    """Rows that training leaves out: the crc32 of the id as text is divisible by 5. A null id is never held out."""
    return F.coalesce(F.crc32(row_id.cast("string")) % 5 == 0, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score, prediction and worst sentence, by a model of the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = train(docs, labels)
    out = score_texts(docs, model, ("score", "predicted", "n_offending", "worst_start", "worst_end"), drop=["text"])
    return out.withColumn("held_out", held_out(F.col("doc_id")))
