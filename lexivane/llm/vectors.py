"""Embedding rows as integer vectors, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str | Column) -> Column:
    """True for a vector that is there, holds an entry, and no null or non-finite one."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fits, F.lit(False))


def scaled(vector: str, scale: int, shift: int = 0) -> Column:
    """floor(scale * c) + shift of every entry as a long, with c as a double."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))


def common_width(df: DataFrame, vector: str) -> int:
    """The length that most vectors have, the greater one in a tie; 0 without vectors."""
    widths = df.groupBy(F.size(vector).alias("w")).count()
    row = widths.orderBy(F.desc("count"), F.desc("w")).first()
    return row["w"] if row else 0


def matrix(column: pa.Array, width: int, number: type = np.int64) -> np.ndarray:
    """Lists of one width as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(number, copy=False).reshape(len(column), width)


def fits_double(*bounds: float) -> bool:
    """Whether a sum of products with this bound is exact in doubles."""
    return float(np.prod([float(b) for b in bounds])) < 2.0**53
