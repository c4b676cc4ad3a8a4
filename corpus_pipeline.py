"""A corpus pipeline of five stages over the table ``documents``.

Each stage takes all that the one before kept and, but for the last, returns the columns of
``documents``. ``run`` writes every stage's rows as Parquet in the shared folder and reads them again;
a stage's table goes when the next one is written.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennyflow.llm import bpe, jaccard_join, langid, mixing, toxicity
from pennyflow.llm.common import column, dropped, free_name, stored, table

#: A document stays if one language labels at least this share of its letters.
LEAST_LANGUAGE = 0.5


def set_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list]:
    """``docs`` with the columns that an operator would take for its own under other names, and what selects all columns as they were."""
    moved = {c: free_name(docs, f"_{c}") for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(moved), [column(moved.get(c, c)).alias(c) for c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, texts without a letter, and those that no language holds half of.

    Texts of any length are judged whole and repeated rows alike; other columns stay, whatever their names. An empty table stays empty.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    apart, back = set_aside(docs, ("lang_pred", "score"))
    out = langid.identify(apart, model, ("lang_pred", "score"))
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*back)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go; null and empty texts, which hold nothing toxic, stay.

    Texts of any length are judged whole and repeated rows alike; other columns stay, whatever their names. An empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(docs, labels)
    apart, back = set_aside(docs, ("predicted",))
    return toxicity.score_texts(apart, model, ("predicted",)).where("predicted = 0").select(*back)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays, of repeated rows one, and all without an id."""
    return jaccard_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without a word as often as the others of their source.

    A null source is a source; repeated rows, and rows without an id, are copied alike. Other columns stay, whatever their names. An empty table stays empty.
    """
    apart, back = set_aside(docs, ("size", "source_size", "target", "rate", "copies", "copy"))
    return mixing.emit_copies(mixing.plan_mix(apart)).select(*back)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of every copy, its token ids and their number, and a digest of the text that they decode to.

    A null text has no ids. Texts of any length are encoded whole, repeated rows each. An empty table stays empty.
    """
    docs = docs.select("doc_id", "lang", "source", "text")
    return bpe.bpe(docs, bpe.public_path(), ("n_tokens", "ids", "decoded_sha256"), drop=["text"])


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return docs
