"""Column functions on vectors held as arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivane import config

_LARGEST = 1.7976931348623157e308


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def floats(vector: Column) -> Column:
    return vector.cast("array<float>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda done, x: done + x)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it in body, also inside a lambda there.

    A column used inside an array lambda is evaluated again for every
    element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(total(F.transform(vector, lambda x: x * x)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def scale(vector: Column, factor: Column) -> Column:
    pair = F.struct(vector.alias("v"), factor.alias("f"))
    return bind(pair, lambda p: F.transform(p["v"], lambda x: x * p["f"]))


def unit(vector: Column, epsilon: float = config.L2_EPSILON) -> Column:
    """Vector over its length; the zero vector stays zero."""
    pair = F.struct(vector.alias("v"), (l2_norm(vector) + epsilon).alias("n"))
    return bind(pair, lambda p: F.transform(p["v"], lambda x: x / p["n"]))


def repair_nan(vector: Column, largest: float = _LARGEST) -> Column:
    """NaN becomes 0 and an infinity the largest finite value of its sign."""

    def repaired(x: Column) -> Column:
        return (
            F.when(F.isnan(x), F.lit(0.0))
            .when(F.abs(x) == float("inf"), F.signum(x) * largest)
            .otherwise(x)
        )

    return F.transform(vector, repaired)


def all_nan(vector: Column) -> Column:
    return F.forall(vector, F.isnan)
