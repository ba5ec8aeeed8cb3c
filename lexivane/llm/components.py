"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.session import written


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = written(edges, "edges")
    mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return edges, tuple(mark)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in (a, b): component is the smallest node reachable.

    Each round links every node to the smallest of its neighbours (large star, then small star) and writes the
    edges to the shared folder; it ends when a round changes nothing. Minima are taken before the shuffle, so a
    node with most of the edges costs one row per task. Loops are dropped; ends must not be null.
    """
    start = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, mark = _written(start.filter("u > v").distinct())
    while mark[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(ends).alias("e"))
        after, new = _written(small.select("e.u", "e.v").filter("u > v").distinct())
        if new == mark:
            break
        now, mark = after, new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
