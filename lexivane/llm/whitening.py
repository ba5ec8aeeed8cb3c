"""Embedding whitening: exact moments over distinct vectors, components by QDWH divide and conquer, one broadcast projection.

Tasks add up integers: first the number of distinct vectors and the sum of every dimension, then products of entries less a
whole number near their mean. The covariance is the correctly rounded quotient of these sums, so it doesn't depend on the
order in which tasks end or are run again. It has width x width entries whatever the number of rows is; its components are
found on the driver and sent to the rows, width numbers each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm import common, spectral, vectors
from lexivane.session import written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LEAST_SHARE = 1e-10  # of the greatest variance; components below it are rounding errors and have no unit variance
_LARGEST = 1 << 52


@dataclass
class Model:
    """n distinct vectors, per dimension a whole number `near` the mean and the sum of what is left; falling values."""

    width: int
    n: int
    near: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S of integer rows, in whole numbers of any size."""
        y = x - self.near
        most = max(int(np.abs(y).max(initial=0)), 1) * self.n + max(map(abs, self.rest), default=0)
        if most < 1 << 62:
            return y * np.int64(self.n) - np.array(self.rest, np.int64)
        return y.astype(object) * self.n - np.array(self.rest, object)

    def whitened(self, offsets: np.ndarray) -> np.ndarray:
        return (offsets / self.n).astype(float) @ (self.vectors / np.sqrt(self.values))


def integer_rows(df: DataFrame, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """df's usable rows with `x`, floor(scale * entry) + shift; entries are held at 2^52 in size."""
    bound = F.lit(float(_LARGEST))
    held = F.transform(vector, lambda c: F.greatest(F.least(c.cast("double") * scale, bound), -bound))
    return df.filter(vectors.usable(vector)).withColumn("x", vectors.scaled(held, 1, shift))


def _totals(df: DataFrame, values: Callable, kind: str) -> dict[int, object]:
    """Sums of cells over all tasks: values(batches) gives a task's cell values; there is a fixed number of cells."""
    arrow = pa.decimal128(38, 0) if kind != "double" else pa.float64()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = values(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found, arrow)], names=["cell", "value"])

    cells = df.mapInArrow(work, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    return {r["cell"]: r["value"] for r in cells.collect()}


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model:
    """The components of the distinct vectors x of rows."""
    width = vectors.common_width(rows, "x")
    if not width:
        return Model(0, 0, np.zeros(0, np.int64), [], np.zeros(0), np.zeros((0, 0)), 0.0)
    distinct = written(rows.filter(F.size("x") == width).select("x").distinct(), "vectors")

    def sums(batches: Iterator[pa.RecordBatch]) -> list[int] | None:
        total, n = [0] * width, 0
        for batch in batches:
            x = vectors.matrix(batch.column(0), width)
            n += len(x)
            total = [t + s for t, s in zip(total, x.sum(axis=0, dtype=object if len(x) * _LARGEST >= 1 << 62 else np.int64).tolist())]
        return [int(t) for t in total] + [n] if n else None

    found = _totals(distinct, sums, "decimal(38,0)")
    n = int(found[width])
    near = [int(found[i]) // n for i in range(width)]
    rest = [int(found[i]) - n * near[i] for i in range(width)]
    centre = np.array(near, np.int64)
    upper = np.triu_indices(width)

    def products(batches: Iterator[pa.RecordBatch]) -> list[int] | None:
        total = None
        for batch in batches:
            y = vectors.matrix(batch.column(0), width) - centre
            most = int(np.abs(y).max(initial=0))
            if vectors.fits_double(most, most, max(1, len(y))):
                part = (y.astype(float).T @ y.astype(float)).astype(np.int64)
            else:
                part = y.astype(object).T @ y.astype(object)
            part = part[upper].astype(object)
            total = part if total is None else total + part
        return None if total is None else [int(t) for t in total]

    found = _totals(distinct, products, "decimal(38,0)")
    covariance = np.zeros((width, width))
    for cell, (i, j) in enumerate(zip(*(x.tolist() for x in upper))):
        covariance[i, j] = covariance[j, i] = (n * int(found[cell]) - rest[i] * rest[j]) / (n * n)
    values, axes = spectral.eigen(covariance)
    kept = min(components, int((values > LEAST_SHARE * values[0]).sum()) if values[0] > 0 else 0)
    model = Model(width, n, centre, rest, values[:kept], axes[:, :kept], float(np.trace(covariance)))
    model.identity_error = _identity_error(distinct, model)
    return model


def _identity_error(distinct: DataFrame, model: Model) -> float:
    """Largest entry, in size, of the whitened vectors' covariance less the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    sent = distinct.sparkSession.sparkContext.broadcast(vars(model))  # a plain dict, as executors have no copy of the class

    def moments(batches: Iterator[pa.RecordBatch]) -> list[float] | None:
        total, model = None, Model(**sent.value)
        for batch in batches:
            w = model.whitened(model.offsets(vectors.matrix(batch.column(0), model.width)))
            part = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])  # w is centred already, but for rounding
            total = part if total is None else total + part
        return total

    found = _totals(distinct, moments, "double")
    mean = np.array([found[i] for i in range(k)]) / model.n
    second = np.array([found[k + i] for i in range(k * k)]).reshape(k, k) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def project(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep of rows with x, with deviation (decimal: sum of (n * x - S)^2) and whitened (an array)."""
    sent = rows.sparkSession.sparkContext.broadcast(vars(model))
    names = [f"_c{i}" for i in range(len(keep))]
    rows = rows.filter(F.size("x") == model.width).select(*[F.col(k).alias(n) for k, n in zip(keep, names)], F.col("x").alias("_x"))
    kinds = dict(rows.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        for batch in common.sliced(batches):
            offsets = model.offsets(vectors.matrix(batch.column("_x"), model.width))
            most = int(np.abs(offsets).max(initial=0))
            wide = offsets if most * most * model.width < 1 << 63 else offsets.astype(object)
            deviation = [int(d) for d in (wide * wide).sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in names],
                    pa.array(deviation, pa.decimal128(38, 0)),
                    pa.array(list(model.whitened(offsets)), pa.list_(pa.float64())),
                ],
                names=[*names, "deviation", "whitened"],
            )

    schema = ", ".join([*[f"{n} {kinds[n]}" for n in names], "deviation decimal(38,0), whitened array<double>"])
    return rows.mapInArrow(work, schema).select(*[F.col(n).alias(k) for n, k in zip(names, keep)], "deviation", "whitened")


def components(df: DataFrame, keep: list[str], vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Rows of df by component: keep, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds a null or non-finite entry are left out, and so are vectors of another
    length than most have. Repeated rows are all returned, but each distinct vector is fitted once. Axes along which the
    fitted vectors don't vary are no components, so a table of one vector, or none, has no rows here.
    """
    common.small_batches(df.sparkSession)
    names = [f"_k{i}" for i in range(len(keep))]
    rows = integer_rows(df.select(*[F.col(k).alias(n) for k, n in zip(keep, names)], F.col(vector).alias("vector")), "vector")
    model = fit(rows, count)
    long = project(rows, model, names)
    shares = F.array([F.lit(float(v / model.trace)) for v in model.values] or [F.lit(0.0)])
    exploded = long.select(*names, "deviation", F.posexplode("whitened").alias("_at", "_value"))
    return exploded.select(
        *[F.col(n).alias(k) for n, k in zip(names, keep)],
        (F.col("_at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("_value").alias("whitened"),
        shares[F.col("_at")].alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
