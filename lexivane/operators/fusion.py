"""Rank fusion, overlap, reranking and recall over ranked lists.

A ranked list is long: (query_idx, rank, corpus_idx, score).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane import config
from lexivane.functions import vectors
from lexivane.operators.topk import rank_hits

_RANKS = 1 << 32


def reciprocal_rank_fusion(lists: Sequence[DataFrame], k: int = config.RRF_K, top_k: int | None = None) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists; ties keep first-seen order."""
    parts = [
        ranked.select("query_idx", "corpus_idx", "rank", F.lit(number).cast("bigint").alias("_list"))
        for number, ranked in enumerate(lists)
    ]
    fused = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("query_idx", "corpus_idx")
        .agg(
            F.round(F.sum(F.lit(1.0) / (F.col("rank") + k)), 9).alias("score"),
            F.min(F.col("_list") * F.lit(_RANKS) + F.col("rank")).alias("_seen"),
        )
    )
    order = Window.partitionBy("query_idx").orderBy(F.desc("score"), F.asc("_seen"))
    ranked = fused.withColumn("rank", F.row_number().over(order).cast("bigint"))
    if top_k is not None:
        ranked = ranked.filter(F.col("rank") <= top_k)
    return ranked.select("query_idx", "rank", "corpus_idx", "score")


def overlap(
    queries: DataFrame, a: DataFrame, b: DataFrame, thresholds: Sequence[int] = config.RECALL_THRESHOLDS
) -> DataFrame:
    """Per query the documents both first-t prefixes share, over t."""
    shared = a.select("query_idx", "corpus_idx", F.col("rank").alias("_a")).join(
        b.select("query_idx", "corpus_idx", F.col("rank").alias("_b")), ["query_idx", "corpus_idx"]
    )
    deeper = F.greatest("_a", "_b")
    counts = shared.groupBy("query_idx").agg(
        *[F.count_if(deeper <= t).alias(f"_at_{t}") for t in thresholds]
    )
    return (
        queries.select("query_idx")
        .join(counts, "query_idx", "left")
        .select(
            "query_idx",
            *[(F.coalesce(F.col(f"_at_{t}"), F.lit(0)) / F.lit(float(t))).alias(f"overlap_at_{t}") for t in thresholds],
        )
    )


def mean_overlap(overlaps: DataFrame, thresholds: Sequence[int] = config.RECALL_THRESHOLDS) -> DataFrame:
    return overlaps.agg(*[F.round(F.avg(f"overlap_at_{t}"), 6).alias(f"overlap_at_{t}") for t in thresholds])


def rerank(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, final_k: int = config.TOP_K) -> DataFrame:
    """Candidates rescored by the dot product of other vectors, cut at final_k.

    queries (query_idx, vector) and corpus (corpus_idx, vector).
    """
    scored = (
        candidates.select("query_idx", "corpus_idx")
        .join(corpus.select("corpus_idx", F.col("vector").alias("_d")), "corpus_idx")
        .join(queries.select("query_idx", F.col("vector").alias("_q")), "query_idx")
        .select("query_idx", "corpus_idx", F.round(vectors.dot(F.col("_q"), F.col("_d")), 6).alias("score"))
    )
    return rank_hits(scored, final_k)


def recall_by_query(
    queries: DataFrame, ranked: DataFrame, thresholds: Sequence[int] = config.RECALL_THRESHOLDS
) -> DataFrame:
    """1 where the gold document is among the first t; 0 where there is none.

    queries (query_idx, corpus_idx) hold the gold ordinal, null for no gold.
    """
    gold = queries.select("query_idx", F.col("corpus_idx").alias("_gold"))
    found = (
        ranked.join(gold, "query_idx")
        .filter(F.col("corpus_idx") == F.col("_gold"))
        .groupBy("query_idx")
        .agg(F.min("rank").alias("_rank"))
    )
    hit = [F.coalesce((F.col("_rank") <= t).cast("int"), F.lit(0)).alias(f"recall_at_{t}") for t in thresholds]
    return gold.join(found, "query_idx", "left").select(
        "query_idx", F.col("_gold").isNotNull().alias("answerable"), *hit
    )


def mean_recall(recalls: DataFrame, thresholds: Sequence[int] = config.RECALL_THRESHOLDS) -> DataFrame:
    """(metric, value): recall over all queries and over the answerable ones."""
    answerable = F.col("answerable")
    named = []
    for t in thresholds:
        column = F.col(f"recall_at_{t}").cast("double")
        named.append((f"recall_at_{t}", F.avg(column)))
        named.append((f"recall_answerable_at_{t}", F.avg(F.when(answerable, column))))
    one = recalls.agg(*[value.alias(name) for name, value in named])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(n, 6).alias("value")) for n, _ in named])
    return one.select(F.inline(rows))
