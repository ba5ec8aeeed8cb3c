"""Principal components of token vectors and of embedding columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.functions import vectors
from lexivane.operators.knn import matrix
from lexivane.sources.ordering import free_names

_WHOLE_WIDTH = 256  # up to this width one pass gives the covariance itself
_SPARE = 10  # columns beyond those asked for
_MOST_ROUNDS = 40
_RESIDUAL = 1e-11


def _summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], cells: int) -> np.ndarray:
    """Sum over all rows (vector, weight) of what part gives for a batch: a fixed number of cells, added up in the tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], names=["cell", "value"])

    found = rows.mapInArrow(work, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(cells)
    out[found["cell"].to_numpy()] = found["value"].to_numpy()
    return out


def leading_axes(
    times: Callable[[np.ndarray], np.ndarray], width: int, k: int, whole: int = _WHOLE_WIDTH, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """(values, axes) of the k leading eigenvectors of a symmetric matrix that is known by its products.

    times(block) multiplies it with a width x b block, in one pass over the rows. Up to the width `whole` one pass gives the
    matrix. Beyond it the blocks of a Krylov space are made orthogonal one after another, until the
    vectors found in it leave no residual; the driver holds width x k numbers for each pass.
    """
    if width <= whole:
        full = times(np.eye(width))
        values, axes = np.linalg.eigh((full + full.T) / 2)
        return values[::-1][:k], axes[:, ::-1][:, :k]
    block, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + _SPARE))))
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(_MOST_ROUNDS):
        made = times(block)
        basis, image = np.hstack([basis, block]), np.hstack([image, made])
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        axes = basis @ turn
        residual = np.linalg.norm(image @ turn - axes * values, axis=0).max()
        if residual <= _RESIDUAL * max(abs(values[0]), 1e-300) or basis.shape[1] >= width:
            break
        for _ in range(2):
            made = made - basis @ (basis.T @ made)
        left, sizes, _ = np.linalg.svd(made, full_matrices=False)
        block = left[:, sizes > 1e-13 * max(sizes.max(), 1e-300)][:, : width - basis.shape[1]]
        block, _ = np.linalg.qr(block - basis @ (basis.T @ block))
        if not block.shape[1]:
            break
    return values, axes


class Projection:
    """A fitted rotation: centred on the fitted rows, signs fixed so that the
    largest loading of every axis is positive.

    fit_rows may stand for several points each: with `weights`, three columns
    that hold the number of points and the sums of their factors and of the
    factors' squares, a row's points are its vector times those factors.
    """

    def __init__(self, fit_rows: DataFrame, column: str, k: int, weights: tuple[str, str, str] | None = None):
        vector = vectors.doubles(F.col(column))
        width = fit_rows.agg(F.max(F.size(column))).first()[0]
        names = weights or (None, None, None)
        number, first, second = (F.lit(1.0) if c is None else F.col(c).cast("double") for c in names)
        self.n = fit_rows.agg(F.sum(number)).first()[0]
        self.mean = _summed(fit_rows.select(vector.alias("vector"), first.alias("weight")), lambda v, w: w @ v, width) / self.n
        rows = fit_rows.select(vector.alias("vector"), second.alias("weight"))
        shift = self.mean if weights is None else np.zeros(width)
        spread = self.n * (self.mean - shift)

        def times(block: np.ndarray) -> np.ndarray:
            part = _summed(rows, lambda v, w: ((v - shift) * w[:, None]).T @ ((v - shift) @ block), block.size)
            return (part.reshape(block.shape) - np.outer(spread, self.mean @ block)) / max(1.0, self.n - 1.0)

        squares = _summed(rows, lambda v, w: w @ (v - shift) ** 2, width).sum() - spread @ self.mean
        self.values, axes = leading_axes(times, width, k)
        loads = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
        self.axes = axes * np.where(loads < 0, -1.0, 1.0)
        self.offset = self.mean @ self.axes
        total = squares / max(1.0, self.n - 1.0)
        self.explained = self.values / total if total > 0 else np.zeros(k)

    def apply(self, df: DataFrame, column: str, out: str | None = None) -> DataFrame:
        """Replace the column (or add out) by its projection."""
        sent = df.sparkSession.sparkContext.broadcast((self.axes, self.offset))
        (made,) = free_names(df.columns, "projected")
        kept = [c for c in df.columns if c != (out or column)]
        fed = df.select(*[F.col(f"`{c}`") for c in kept], vectors.doubles(F.col(column)).alias(made))
        kind = T.StructType(fed.schema.fields[:])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            axes, offset = sent.value
            for batch in batches:
                column = batch.column(made)
                flat = np.zeros((batch.num_rows, axes.shape[1]))
                there = column.is_valid().to_numpy(zero_copy_only=False)
                if there.any():
                    flat[there] = matrix(column.drop_null()) @ axes - offset
                ends = pa.array(np.arange(len(flat) + 1) * axes.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(flat.ravel()), mask=pa.array(~there))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists], names=[*kept, made])

        projected = fed.mapInArrow(work, kind).withColumnRenamed(made, out or column)
        return projected.select(*[F.col(f"`{c}`") for c in df.columns if c != out], *([F.col(out)] if out else []))

    def variance_report(self, df: DataFrame) -> DataFrame:
        """(component, ratio): share of the variance per component."""
        rows = [(i, float(v)) for i, v in enumerate(self.explained)]
        return df.sparkSession.createDataFrame(rows, "component bigint, ratio double")


def reduce_dimensions(
    df: DataFrame, column: str, dims: int | str | None, counts: DataFrame | None = None, key: str = "token_id"
) -> DataFrame:
    """Project the vectors on their first dims components.

    With counts (token_id, n), the fit sees only tokens counted at least once;
    if there are none it sees all. dims: None leaves the vectors alone, "auto"
    and anything wider than the vectors mean full width, and as many dims as
    there are rows leave them alone too.
    """
    if dims is None:
        return df
    fit_rows = df
    if counts is not None:
        seen = counts.filter(F.col("n") >= 1).select(key)
        fit_rows = df.join(seen, key, "left_semi")
    found = df.agg(F.count(F.lit(1)), F.max(F.size(column))).first()
    rows, width = found[0], found[1] or 0
    fit_count = fit_rows.count() if counts is not None else rows
    if fit_count == 0:
        fit_rows, fit_count = df, rows
    dims = width if dims == "auto" else min(int(dims), width)
    if dims >= rows:
        return df
    if dims > fit_count:
        raise ValueError(f"{dims} components need as many rows to fit, found {fit_count}")
    return Projection(fit_rows, column, dims).apply(df, column)


def reduce_column(df: DataFrame, n_components: int = 50, column: str = "embedding") -> DataFrame:
    """Replace an embedding column by its principal components."""
    return Projection(df, column, n_components).apply(df, column)
