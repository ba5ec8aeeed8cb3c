"""Query / positive / negative triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions import text
from lexivane.sources.ordering import dense_index, source_index

COMPLETE = "has_positive_and_negative"


def has_positive_and_negative() -> Column:
    """Both texts are there; a blank one counts as there."""
    return F.col("positive").isNotNull() & F.col("negative").isNotNull()


def flag_triplets(triplets: DataFrame) -> DataFrame:
    return triplets.withColumn(COMPLETE, has_positive_and_negative()).withColumn(
        "query_instruct", text.detailed_instruct(F.col("query"))
    )


def load_triplets(spark: SparkSession, path: str, language: str, order: list[str | Column] | None = None) -> DataFrame:
    """Rows of one language, flagged and numbered 0..n-1: as they stand in the files, or in a given order."""
    spoken = F.col("language") == language
    if order is None:
        return flag_triplets(source_index(spark, path, spoken))
    return flag_triplets(dense_index(spark.read.parquet(path).filter(spoken), order))


def complete_pairs(triplets: DataFrame) -> DataFrame:
    return triplets.filter(has_positive_and_negative())


def first_rows(triplets: DataFrame, limit: int | None) -> DataFrame:
    """The first rows by index, also where a filter has left gaps in it."""
    if limit is None:
        return triplets
    last = triplets.select("idx").orderBy("idx").limit(limit).agg(F.max("idx"))
    return triplets.filter(F.col("idx") <= last.scalar())
