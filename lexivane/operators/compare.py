"""Comparison of models, vocabularies and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane import config
from lexivane.functions import text, vectors
from lexivane.operators.pca import Projection
from lexivane.session import written


def compare_models(first: DataFrame, other: DataFrame) -> DataFrame:
    """Both models' token maps side by side, with flags and differences.

    Inputs hold (index, text, projection_x, projection_y); a token only one
    model has leaves the other's columns null.
    """
    right = other.select(
        "text",
        F.col("projection_x").alias("other_projection_x"),
        F.col("projection_y").alias("other_projection_y"),
        F.lit(True).alias("_right"),
    )
    left = first.select("index", "text", "projection_x", "projection_y", F.lit(True).alias("_left"))
    joined = left.join(right, "text", "full_outer")
    return joined.select(
        "index",
        "text",
        "projection_x",
        "projection_y",
        "other_projection_x",
        "other_projection_y",
        F.col("_right").isNull().cast("int").alias("is_redundant"),
        F.col("_left").isNull().cast("int").alias("only_in_other"),
        (F.col("other_projection_x") - F.col("projection_x")).alias("diff_projection_x"),
        (F.col("other_projection_y") - F.col("projection_y")).alias("diff_projection_y"),
    )


def vocabulary_difference(first: DataFrame, other: DataFrame, samples: int = 10) -> DataFrame:
    """(side, n, tokens): tokens only one vocabulary has, with a small sample.

    One pass over both; the sample is the first tokens in order.
    """
    a = first.select("token", F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = other.select("token", F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    sides = a.unionByName(b).groupBy("token").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    side = F.when(F.col("_b") == 0, "only_in_first").when(F.col("_a") == 0, "only_in_other").otherwise("in_both")
    marked = sides.select("token", side.alias("side"))
    counts = marked.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    # A ranked filter keeps `samples` rows per side before they meet.
    order = Window.partitionBy("side").orderBy("token")
    kept = (
        marked.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= samples)
        .groupBy("side")
        .agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("tokens"))
    )
    return counts.join(kept, "side")


def token_map(model: DataFrame, x: Column | None = None, y: Column | None = None) -> DataFrame:
    """(index, text, projection_x, projection_y) from the first two dims."""
    v = vectors.doubles(F.col("vector"))
    return model.select(
        F.col("token_id").alias("index"),
        F.col("token").alias("text"),
        (v[0] if x is None else x).alias("projection_x"),
        (v[1] if y is None else y).alias("projection_y"),
    )


def contributions(tokens: DataFrame, key: Sequence[str]) -> DataFrame:
    """Token vectors over the number of tokens of their text, in `share`."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key)).cast("double")
    return tokens.withColumn("_n", n).withColumn(
        "share", vectors.scale(F.col("vector"), F.lit(1.0) / F.col("_n"))
    ).drop("_n")


def token_arrows(shares: DataFrame, key: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Head-to-tail arrows of a text's tokens, from the origin.

    shares: key, position, token, x, y, l2_norm, where (x, y) is what a token
    contributes. Every arrow starts where the one before it ends.
    """
    so_far = Window.partitionBy(*key).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = shares.withColumn("end_x", F.sum(x).over(so_far)).withColumn("end_y", F.sum(y).over(so_far))
    width = F.greatest(F.lit(1.0), F.least(F.lit(20.0), F.col("l2_norm")))
    start_x, start_y = F.col("end_x") - F.col(x), F.col("end_y") - F.col(y)
    return chained.select(
        *key,
        "position",
        "token",
        start_x.alias("start_x"),
        start_y.alias("start_y"),
        "end_x",
        "end_y",
        ((start_x + F.col("end_x")) / 2).alias("mid_x"),
        ((start_y + F.col("end_y")) / 2).alias("mid_y"),
        width.alias("line_width"),
    )


def project_contributions(shares: DataFrame, means: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contributions and mean vectors in the plane of the contributions' two
    largest components; adds x and y to both.

    shares holds `share`, means the mean vector of every text in `vector`.
    """
    plane = Projection(shares, "share", 2)

    def flat(df: DataFrame, column: str) -> DataFrame:
        return plane.apply(df, column, "_xy").withColumn("x", F.col("_xy")[0]).withColumn("y", F.col("_xy")[1]).drop("_xy")

    return flat(shares, "share"), flat(means, "vector")


def parent_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("parent_run").isNull())


def numeric_parameter(value: Column) -> Column:
    """A parameter string as a whole number; anything else is null."""
    return value.try_cast("int")


def select_runs(
    runs: DataFrame, names: Sequence[str] = (), containing: str | None = None, also: str | None = None
) -> DataFrame:
    """Runs in a set of names, holding a piece of text, or equal to a name."""
    wanted = F.lit(False)
    if names:
        wanted = wanted | F.col("run_name").isin(*names)
    if containing is not None:
        wanted = wanted | F.col("run_name").contains(containing)
    if also is not None:
        wanted = wanted | (F.col("run_name") == also)
    return runs.filter(wanted)


def first_runs(runs: DataFrame, by: Sequence[str], flag: str | None = None, order: str = "start_ord") -> DataFrame:
    """First run per group with the group's size; a missing flag is false."""
    others = [c for c in runs.columns if c not in by]
    earliest = F.min_by(F.struct(*others), F.col(order)).alias("_first")
    firsts = runs.groupBy(*by).agg(earliest, F.count(F.lit(1)).alias("n_runs"))
    firsts = firsts.select(*by, "_first.*", "n_runs")
    if flag is not None:
        firsts = firsts.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return firsts


def sort_runs(runs: DataFrame, column: str) -> DataFrame:
    return runs.orderBy(F.col(column).asc_nulls_last())


def named_runs(runs: DataFrame, output_dim: str = "output_dim") -> DataFrame:
    return runs.withColumn("run_name", text.run_label(F.col(output_dim), runs.columns))


def text_points(
    texts: DataFrame,
    key: Sequence[str],
    source: str,
    model: DataFrame,
    axes: Sequence[Column] | None = None,
    send_bytes: int = config.BROADCAST_BYTES,
) -> DataFrame:
    """Written (key, position, token, x, y, l2_norm): a text's known tokens on two axes of the model, by default its first two.

    The model is cut down to three numbers a token before it meets the texts.
    Up to send_bytes it is sent to them, so that tokens stay where they are.
    """
    vector = vectors.doubles(F.col("vector"))
    x, y = axes or (vector[0], vector[1])
    narrow = model.select("token", x.alias("x"), y.alias("y"), vectors.l2_norm(vector).alias("l2_norm"))
    narrow = written(narrow, "narrow-model")
    size = narrow.agg(F.sum(F.octet_length("token") + 64)).first()[0] or 0
    tokens = texts.select(*key, F.posexplode(text.words(F.col(source))).alias("position", "token"))
    return written(tokens.join(F.broadcast(narrow) if size <= send_bytes else narrow, "token"), "points")


def point_weights(points: DataFrame, key: Sequence[str]) -> DataFrame:
    """(token, n, share, square): how often a token occurs, and the sums of 1 / (tokens of its text) and of its square."""
    sizes = points.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    held = points.groupBy(*key, "token").agg(F.count(F.lit(1)).cast("double").alias("_times")).join(sizes, list(key))
    share = F.col("_times") / F.col("_n")
    return held.groupBy("token").agg(F.sum("_times").alias("n"), F.sum(share).alias("share"), F.sum(share / F.col("_n")).alias("square"))


def chain_arrows(
    points: DataFrame, key: Sequence[str], offset: Sequence[float] = (0.0, 0.0), block_tokens: int = 1024
) -> DataFrame:
    """The arrows of token_arrows from text_points.

    A token contributes (x, y) over the number of its text's known tokens, less
    the offset. Positions are added up in two steps, inside blocks of positions
    and over the blocks of a text, so that a very long text is many tasks.
    """
    keys = list(key)
    blocked = points.withColumn("_block", F.floor(F.col("position") / block_tokens))
    sums = [F.sum(c).alias(f"_{c}") for c in ("x", "y")]
    blocks = blocked.groupBy(*keys, "_block").agg(*sums, F.count(F.lit(1)).alias("_held"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0.0)).alias(f"_before_{c}") for c in ("x", "y")],
        F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"),
        F.sum("_held").over(Window.partitionBy(*keys)).cast("double").alias("_n"),
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.col("_before") + F.count(F.lit(1)).over(inside)
    joined = blocked.join(starts, [*keys, "_block"]).withColumn("_place", place)
    for c, o in zip(("x", "y"), offset):
        joined = joined.withColumn(f"end_{c}", (F.col(f"_before_{c}") + F.sum(c).over(inside)) / F.col("_n") - F.col("_place") * float(o))
    width = F.greatest(F.lit(1.0), F.least(F.lit(20.0), F.col("l2_norm")))
    start_x, start_y = (F.col(f"end_{c}") - (F.col(c) / F.col("_n") - float(o)) for c, o in zip(("x", "y"), offset))
    return joined.select(
        *keys,
        "position",
        "token",
        start_x.alias("start_x"),
        start_y.alias("start_y"),
        "end_x",
        "end_y",
        ((start_x + F.col("end_x")) / 2).alias("mid_x"),
        ((start_y + F.col("end_y")) / 2).alias("mid_y"),
        width.alias("line_width"),
    )


def weighted_plane(model: DataFrame, weights: DataFrame) -> Projection:
    """The plane of the contributions' two largest components, fitted on tokens by weight instead of on every occurrence."""
    rows = written(model.select("token", "vector").join(weights, "token"), "weighted-tokens")
    return Projection(rows, "vector", 2, ("n", "share", "square"))
