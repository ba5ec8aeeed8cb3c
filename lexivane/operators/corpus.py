"""Long-form corpora and the query side that belongs to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.functions import text
from lexivane.sources.ordering import dense_index

CORPUS_COLUMNS = ("positive", "negative")
FEATURE_COLUMNS = ("query", "negative", "positive")


def create_corpus(
    df: DataFrame,
    columns: Sequence[str] = CORPUS_COLUMNS,
    add_columns: Sequence[str] = (),
    idx: str = "idx",
) -> DataFrame:
    """One row per text cell that is there and not blank.

    `position` is the place of the source column; row-major order is
    (query_idx, position).
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("document")) for c in columns]
    )
    return (
        df.select(F.col(idx).alias("query_idx"), *add_columns, F.posexplode(cells).alias("position", "_cell"))
        .select("query_idx", "_cell.document", "_cell.column", *add_columns, "position")
        .filter(text.not_blank(F.col("document")))
    )


def index_corpus(corpus: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    """Number the corpus 0..n-1 in row-major order."""
    return dense_index(corpus, ["query_idx", "position"], "corpus_idx", rows_per_bucket=rows_per_bucket).drop(
        "position"
    )


def stack_texts(df: DataFrame, columns: Sequence[str], idx: str = "idx") -> DataFrame:
    """All texts of the first column, then all of the second, and so on.

    `ord` orders the texts: column place first, then idx.
    """
    cells = F.array(*[F.col(c) for c in columns])
    n = df.agg(F.max(idx)).first()[0] or 0
    return df.select(F.col(idx), F.posexplode(cells).alias("_place", "text")).select(
        (F.col("_place") * F.lit(n + 1) + F.col(idx)).cast("bigint").alias("ord"), "text"
    )


def gold_documents(corpus: DataFrame) -> DataFrame:
    """query_idx -> ordinal of its positive; the last one wins."""
    return (
        corpus.filter(F.col("column") == "positive")
        .groupBy("query_idx")
        .agg(F.max("corpus_idx").alias("corpus_idx"))
    )


def add_corpus_idx(queries: DataFrame, gold: DataFrame) -> DataFrame:
    """Left lookup of the gold document; null where there is none."""
    return queries.join(gold.withColumnRenamed("query_idx", "idx"), "idx", "left")


def corpus_and_queries(triplets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries with their gold ordinal, gold mapping)."""
    corpus = index_corpus(create_corpus(triplets))
    gold = gold_documents(corpus)
    queries = add_corpus_idx(triplets.select("idx", "query", "query_instruct"), gold)
    return corpus, queries, gold


def add_lengths(corpus: DataFrame, max_length: int, doc_max_length: int, tokenize=text.words) -> DataFrame:
    n_tokens = F.size(tokenize(F.col("document")))
    return corpus.withColumn("n_tokens", F.least(n_tokens, F.lit(max_length)).cast("bigint")).withColumn(
        "fits_length", text.fits_length(F.col("n_tokens"), max_length, doc_max_length)
    )


def length_report(checked: DataFrame) -> DataFrame:
    """Rows kept, rows dropped and the kept share; share 0 on no rows."""
    kept = F.count_if("fits_length")
    rows = F.count(F.lit(1))
    return checked.agg(
        kept.alias("kept"),
        (rows - kept).alias("dropped"),
        F.round(F.coalesce(F.try_divide(kept, rows), F.lit(0.0)), 6).alias("ratio"),
    )
