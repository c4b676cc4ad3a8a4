"""Embedding whitening by LOBPCG: leading components of the covariance without ever forming it.

The covariance of all distinct rows is met only as a product with a few columns: every task centres its rows x and adds up
x' (x B), and the tasks' blocks are summed by Spark. The driver keeps three blocks of columns, the iterate X, the
residuals W and the previous directions P, and takes the best combinations of them (Rayleigh-Ritz). One pass over the rows is
made for each iteration, over W alone: the products of X and P follow from those that are known. When the residuals look small
enough, X is multiplied anew by one more pass, and only residuals of that product certify it.

If so many passes have not certified the wanted columns, the block doubles; a block of all dimensions is exact, so that the search
always ends. The driver and a broadcast hold dimensions times block numbers, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, dropped, small_batches, stored, table
from .vectors import common_length, finite, floored, matrix, summed

COMPONENTS, SCALE = 4, 256
#: Columns that are carried beside the wanted ones, for faster convergence, and passes before the block doubles.
GUARD, PATIENCE = 12, 40
EPS = np.finfo(np.float64).eps
LONG = 1 << 63


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block's columns add to the orthonormal columns of ``against``; columns that add nothing go."""
    for _ in range(2):
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        block = block - against @ (against.T @ block)
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-8]
    return block


def ritz(basis: np.ndarray, product: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling Ritz values of an orthonormal basis, and the combinations of its columns that have them."""
    small = basis.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1][:most], turn[:, ::-1][:, :most]


def lobpcg(apply: Callable[[np.ndarray], np.ndarray], length: int, want: int, guard: int = GUARD, patience: int = PATIENCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues of a symmetric positive operator, unit eigenvectors as columns, and their certified residuals.

    ``apply`` multiplies a block of columns. A residual is certified if a fresh product bears out that it is
    at rounding level of the largest eigenvalue; a basis of all dimensions is exact as it is.
    """
    drawn, width = np.random.default_rng(seed), min(length, want + guard)
    tolerance = 4 * EPS * max(64, length)
    x = np.linalg.qr(drawn.standard_normal((length, width)))[0]
    while True:
        ax, p, ap, fresh = apply(x), None, None, True
        values, turn = ritz(x, ax, width)
        x, ax = x @ turn, ax @ turn
        for _ in range(patience):
            residual = ax - x * values
            sizes = np.linalg.norm(residual[:, :want], axis=0)
            if width == length or (sizes <= tolerance * max(values[0], 0.0)).all():
                if fresh:
                    return values[:want], x[:, :want], sizes
                x = np.linalg.qr(x)[0]
                ax, p, fresh = apply(x), None, True
                values, turn = ritz(x, ax, width)
                x, ax = x @ turn, ax @ turn
                continue
            known = x if p is None else np.concatenate([x, p], axis=1)
            w = orthonormal(residual, known)
            basis, product = np.concatenate([known, w], axis=1), np.concatenate([ax, *([] if p is None else [ap]), apply(w)], axis=1)
            values, turn = ritz(basis, product, width)
            # The previous directions: what the new iterate took from beside the old one, at right angles to the new one.
            moved = turn.copy()
            moved[:width] = 0.0
            back = orthonormal(moved, turn)
            x, ax, p, ap, fresh = basis @ turn, product @ turn, basis @ back, product @ back, False
        more = min(length, 2 * width) - width
        x, width = np.concatenate([x, orthonormal(drawn.standard_normal((length, more)), np.linalg.qr(x)[0])], axis=1), width + more
        x = np.linalg.qr(x)[0]


def centred(batch: pa.RecordBatch, mean: np.ndarray) -> np.ndarray:
    return matrix(batch.column("x"), len(mean)).astype(np.float64) - mean


def totals(fit: DataFrame, length: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(length + 1, object)
        for batch in batches:
            x = matrix(batch.column("x"), length)
            small = not len(x) or float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0**62
            total[:length] += (x if small else x.astype(object)).sum(axis=0).astype(object)
            total[length] += len(x)
        return total

    found = summed(fit, add, "decimal(38,0)")
    return int(found.get(length, 0)), [int(found.get(k, 0)) for k in range(length)]


def product_with(fit: DataFrame, mean: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """What multiplies a block of columns by the covariance of the rows, in one pass over them."""

    def apply(block: np.ndarray) -> np.ndarray:
        held = fit.sparkSession.sparkContext.broadcast((mean, block))

        def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            mean_, block_ = held.value
            total = np.zeros(block_.shape)
            for batch in batches:
                x = centred(batch, mean_)
                total += x.T @ (x @ block_)
            return total

        found = summed(fit, add)
        held.destroy()
        out = np.zeros(block.size)
        out[list(found)] = list(found.values())
        return out.reshape(block.shape) / n

    return apply


def moments(fit: DataFrame, mean: np.ndarray, n: int, maps: np.ndarray) -> tuple[float, float]:
    """The covariance's trace, and the largest absolute entry of the whitened rows' covariance minus the identity."""
    k = maps.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            x = centred(batch, mean)
            w = x @ maps
            total += np.concatenate([[(x * x).sum()], w.sum(axis=0), (w.T @ w).ravel()])
        return total

    found = summed(fit, add)
    flat = np.array([found.get(i, 0.0) for i in range(1 + k + k * k)]) / n
    covariance = flat[1 + k :].reshape(k, k) - np.outer(flat[1 : 1 + k], flat[1 : 1 + k])
    return float(flat[0]), float(np.abs(covariance - np.eye(k)).max()) if k else 0.0


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The exact sum over dimensions of (n * x - S)**2 of each row; null where it doesn't fit a long."""
    about = ((x.astype(np.float64) * n - np.array(sums, np.float64)) ** 2).sum(axis=1)
    plain = (about < 0.99 * LONG) & (np.abs(x.astype(np.float64)).max(axis=1) * n < 2.0**62)
    out: list[int | None] = [None] * len(x)
    if plain.any() and max(map(abs, sums)) < 1 << 62:
        exact = ((x[plain] * n - np.array(sums, np.int64)) ** 2).sum(axis=1)
        for k, v in zip(np.flatnonzero(plain).tolist(), exact.tolist(), strict=True):
            out[k] = v
    else:
        plain[:] = False
    for k in np.flatnonzero(~plain & (about < 1.01 * LONG)).tolist():
        value = sum((n * int(v) - s) ** 2 for v, s in zip(x[k].tolist(), sums, strict=True))
        out[k] = value if value < LONG else None
    return pa.array(out, pa.int64())


def whitened(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error and residual: a row for each vector and component.

    Vectors become whole numbers floor(scale * c), saturated to longs; distinct ones are the fit list, n of them. Null and empty vectors and those
    that hold a null or non-finite number take no part, nor do those of another length than most have (of equally
    frequent lengths the longest). Repeated rows and rows without an id are given like all others, but count once in the fit.
    ``residual`` is the certified norm of V v - e v. Components whose eigenvalue is zero but for rounding aren't given: with one distinct vector
    there are none, and fewer than ``components`` where dimensions or distinct vectors are fewer. ``deviation`` is null where it doesn't fit a long.
    An empty table gives an empty table. Of columns only the two are read, whatever the names of others. Signs are such that a component's entry of largest size is positive.
    """
    spark = rows.sparkSession
    kept = rows.select(column(id_col).alias("id"), column(vec_col).alias("v")).where(finite("v"))
    length = common_length(kept, "v")
    kept = kept.where(F.size("v") == length).select("id", floored("v", scale).alias("x"))
    schema = f"id {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    if not length:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    fit = stored(kept.select("x").distinct())
    n, sums = totals(fit, length)
    mean = np.array([s / n for s in sums])
    values, vectors, residuals = lobpcg(product_with(fit, mean, n), length, min(components, length))
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = moments(fit, mean, n, vectors[:, :0])[0]
    held = values > 8 * EPS * max(64, length) * trace
    values, vectors, residuals = values[held], (vectors * signs)[:, held], residuals[held]
    maps = vectors / np.sqrt(values)
    error = moments(fit, mean, n, maps)[1]
    dropped(fit)
    k, explained = len(values), values / trace if trace else values
    shared = spark.sparkContext.broadcast((sums, mean, maps))
    small_batches(spark)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums_, mean_, maps_ = shared.value
        for batch in batches:
            if k and batch.num_rows:
                row, at = np.repeat(np.arange(batch.num_rows), k), np.tile(np.arange(k), batch.num_rows)
                x = matrix(batch.column("x"), length)
                white = (x.astype(np.float64) - mean_) @ maps_
                full = np.ones(len(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(row)), pa.array(at + 1, pa.int32()), pa.array(np.full(len(row), n), pa.int64()), deviations(x, n, sums_).take(pa.array(row)),
                        pa.array(white.ravel()), pa.array(explained[at]), pa.array(full * error), pa.array(residuals[at]),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
                )

    return kept.mapInArrow(project, schema).withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector on the four leading components of all, whitened."""
    return whitened(table(spark, sf_dir, "embeddings"))
