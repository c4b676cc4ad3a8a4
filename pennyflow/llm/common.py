"""Helpers that the corpus operators share: tables, clashing names, cut lineage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Whether shuffle files go when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word: a run of anything but space and the five ASCII controls from tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder, which may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame without the columns whose names equal one of ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[column(c) for c in df.columns if c.lower() not in taken])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many more underscores before it as make it unlike every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ensure_shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's ``spark.checkpoint.dir``, which a cluster names.

    Only in local mode, where driver and executors are one process, a temporary folder is made if it is unset.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The frame computed once and kept in the shared folder, so that lost executors lose nothing."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, as a compressed Parquet table in the shared folder: for wide or large frames. ``dropped`` deletes it."""
    spark = df.sparkSession
    path = f"{ensure_shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # once the table is written, nothing reads its plan's shuffles
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of ``stored`` tables that no plan still to run reads."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a batch that Spark hands to a Python worker.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets the session hand rows to Python workers in batches of at most BATCH_BYTES, whatever the rows' length; results don't change."""
    if not 0 < int(spark.conf.get(_BATCH_CONF).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


#: What a task works on at a time: rows, and bytes of texts after which no more rows are added.
PIECE_ROWS, PIECE_BYTES = 512, 4 << 20


def pieces(batch: pa.RecordBatch, places: Sequence[int], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in pieces that are bounded by rows and by the bytes of the columns at ``places``; a longer row is a piece of its own."""
    held = [batch.column(k) for k in places]
    sizes = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in held if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    ends = np.cumsum(np.sum(sizes, axis=0, dtype=np.int64)) if sizes else np.zeros(batch.num_rows, np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def add_columns(
    df: DataFrame, sources: Sequence[str], fields: Sequence[StructField], start: Callable[[], Callable[..., Sequence[pa.Array]]], drop: Sequence[str] = (), rows: int = PIECE_ROWS
) -> DataFrame:
    """Every row of ``df`` with ``fields`` after its own columns, made by Python tasks in one narrow pass.

    A task calls ``start`` once; what that returns makes the fields' arrays from the arrays of the columns
    ``sources``, for a piece of rows at a time. Each column goes to Python once, and those named in ``drop``
    or as one of the fields don't come back.
    """
    gone = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    kept = [c for c in df.columns if c.lower() not in gone]
    at = {c.lower(): k for k, c in enumerate(kept)}
    sent, places = [column(c) for c in kept], []
    for k, name in enumerate(sources):
        places.append(at.get(name.lower(), len(sent)))
        if name.lower() not in at:
            sent.append(column(name).alias(free_name(df, f"_source{k}")))
    small_batches(df.sparkSession)
    frame, n_kept = df.select(*sent), len(kept)
    schema = StructType([*frame.schema.fields[:n_kept], *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for piece in pieces(batch, places, rows):
                yield pa.RecordBatch.from_arrays([*piece.columns[:n_kept], *make(*(piece.column(k) for k in places))], names=names)
        del make
        release()

    return frame.mapInArrow(run, schema)


def release() -> None:
    """Gives back to the system what a task has freed, as a Python worker lives on beside the next tasks' workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
