"""Documents to packed training sequences: language, near duplicates, repeated passages, benchmark leaks, packing.

Every stage works on what the one before kept, and is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexivane.llm import decontamination, jaccard, language, packing, substrings
from lexivane.llm.common import table
from lexivane.session import written

STAGES = [
    ("language", language.stage),
    ("near_duplicates", jaccard.stage),
    ("substrings", substrings.stage),
    ("decontamination", decontamination.stage),
    ("packing", packing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents of sf_dir; stage results are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
