"""Seeded samples, stratified splits and folds.

A row's place in a seeded draw is its rank by a hash of seed and row id. The
operators look up the hash (or index) at the few ranks where a quota ends and
then label every row by comparison, so no row moves and no stratum, however
large, is sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane import config
from lexivane.session import written
from lexivane.sources.ordering import dense_index, keys_at_ranks, sums_before

_LAST = "~"
_FEW_STRATA = 10_000


def draw(idx: str | Column, seed: int) -> Column:
    """Hash that orders a seeded draw."""
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.md5(F.concat_ws(":", F.lit(str(seed)), idx.cast("string")))


def _draw_bucket(key: str) -> Column:
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("int")


def sample_rows(df: DataFrame, n: int, seed: int = config.RANDOM_STATE, idx: str = "idx") -> DataFrame:
    """Exactly min(n, rows) rows, drawn without replacement."""
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn("_draw", draw(idx, seed))
    cuts = df.sparkSession.range(1).select(
        F.lit(0).alias("_all"), F.lit(0).alias("cut"), F.lit(n).cast("bigint").alias("rank")
    )
    keys = hashed.select(F.lit(0).alias("_all"), "_draw")
    last = keys_at_ranks(keys, ["_all"], "_draw", _draw_bucket("_draw"), cuts, True).select("_draw")
    return hashed.filter(F.col("_draw") <= F.coalesce(last.scalar(), F.lit(_LAST))).drop("_draw")


def _quotas(sizes: DataFrame, size: str, share: float, name: str, few: bool) -> DataFrame:
    """Split ceil(share * all) over the strata by largest remainder.

    Base quotas need only the total. What they leave goes to the strata with
    the largest remainders, found by their place in that order: a window where
    the strata are few, dense numbers from range partitions where they are not.
    """
    every = sizes.agg(F.sum(size)).first()[0] or 0
    drawn = math.ceil(float(every) * float(share))
    wide = "decimal(38,0)"
    exact = F.lit(drawn).cast(wide) * F.col(size).cast(wide)
    rest = (exact % F.lit(max(1, every)).cast(wide)).cast("bigint")
    base = ((exact - F.col("_rest").cast(wide)) / F.lit(max(1, every)).cast(wide)).cast("bigint")
    based = sizes.withColumn("_rest", rest).withColumn("_base", base)
    left = drawn - (based.agg(F.sum("_base")).first()[0] or 0)
    order = [F.desc("_rest"), F.asc("stratum")]
    if few:
        placed = based.withColumn("_place", F.row_number().over(Window.orderBy(*order)) - 1)
    else:
        placed = dense_index(based, order, "_place")
    return placed.withColumn(name, F.col("_base") + (F.col("_place") < left).cast("bigint")).drop("_rest", "_base", "_place")


def _strata(df: DataFrame, stratify: str, idx: str, seed: int) -> DataFrame:
    return df.select(F.col(stratify).cast("string").alias("stratum"), draw(idx, seed).alias("_draw"))


def _sizes(keyed: DataFrame, *extra: Column) -> tuple[DataFrame, bool]:
    """Rows per stratum, and whether per-stratum tables are small enough to send
    to every task. A flag has two strata; without that, all rows of one stratum
    would meet in one task just to be labelled."""
    sizes = written(keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"), *extra), "strata")
    return sizes, sizes.count() <= _FEW_STRATA


def _label(df: DataFrame, stratify: str, idx: str, seed: int, cuts: DataFrame, shares: list, few: bool) -> DataFrame:
    """Label rows by the draws at the cut ranks, first matching share first."""
    keyed = _strata(df, stratify, idx, seed)
    found = keys_at_ranks(keyed, ["stratum"], "_draw", _draw_bucket("_draw"), cuts, few)
    limits = found.groupBy("stratum").agg(
        *[F.max(F.when(F.col("cut") == s, F.col("_draw"))).alias(f"_cut_{s}") for s in shares]
    )
    value = F.lit("train")
    for share in reversed(shares):
        value = F.when(F.col("_draw") <= F.col(f"_cut_{share}"), F.lit(share)).otherwise(value)
    return (
        df.withColumn("stratum", F.col(stratify).cast("string"))
        .withColumn("_draw", draw(idx, seed))
        .join(F.broadcast(limits) if few else limits, "stratum", "left")
        .withColumn("split", value)
        .drop("stratum", "_draw", *[f"_cut_{s}" for s in shares])
    )


def stratified_split(
    df: DataFrame,
    test_size: float | None = config.TEST_SIZE,
    stratify: str = "has_positive_and_negative",
    seed: int = config.RANDOM_STATE,
    idx: str = "idx",
) -> DataFrame:
    """Add split = test for ceil(n * test_size) rows, else train.

    Without a test size nothing is held out: every row is marked all, to be
    trained on and evaluated.
    """
    if test_size is None:
        return df.withColumn("split", F.lit("all"))
    sizes, few = _sizes(_strata(df, stratify, idx, seed))
    cuts = _quotas(sizes, "_n", test_size, "rank", few).select("stratum", F.lit("test").alias("cut"), "rank")
    return _label(df, stratify, idx, seed, cuts, ["test"], few)


def add_splits(
    df: DataFrame,
    test_size: float = config.TEST_SIZE,
    val_size: float = config.VAL_SIZE,
    stratify: str = "has_positive_and_negative",
    seed: int = config.RANDOM_STATE,
    idx: str = "idx",
) -> DataFrame:
    """Add split: test first, then val out of the rest, else train."""
    sizes, few = _sizes(_strata(df, stratify, idx, seed))
    quotas = _quotas(sizes, "_n", test_size, "_test", few).withColumn("_rows", F.col("_n") - F.col("_test"))
    quotas = _quotas(quotas, "_rows", val_size, "_val", few)
    ranks = F.array(
        F.struct(F.lit("test").alias("cut"), F.col("_test").alias("rank")),
        F.struct(F.lit("val").alias("cut"), (F.col("_test") + F.col("_val")).alias("rank")),
    )
    cuts = quotas.select("stratum", F.inline(ranks))
    return _label(df, stratify, idx, seed, cuts, ["test", "val"], few)


def stratified_k_fold(
    df: DataFrame,
    k: int = config.N_SPLITS,
    stratify: str = "has_positive_and_negative",
    idx: str = "idx",
) -> DataFrame:
    """Add fold 0..k-1, unshuffled; idx must be dense.

    The strata, in order of first appearance, fill positions 0..n-1; fold i
    takes from a stratum as many rows as it has positions p with p % k = i.
    """
    keyed = df.select(F.col(stratify).cast("string").alias("stratum"), F.col(idx).alias("_key"))
    strata, few = _sizes(keyed, F.min("_key").alias("_first"))
    if few:
        ahead = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
        sizes = strata.withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    else:
        sizes = sums_before(strata, ["_first", "stratum"], "_n", "_start")
    n_below = "cast(floor(({} - cut + {k} - 1) / {k}) as bigint)"
    share = F.expr(f"{n_below.format('(_start + _n)', k=k)} - {n_below.format('_start', k=k)}")
    upto = Window.partitionBy("stratum").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        sizes.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("_share", share)
        .withColumn("rank", F.sum("_share").over(upto))
        .filter(F.col("_share") > 0)
        .select("stratum", "cut", "rank")
    )
    size = max(1, (strata.agg(F.sum("_n")).first()[0] or 0) // 65_536)
    bucket = F.floor(F.col("_key") / size).cast("bigint")
    ends = keys_at_ranks(keyed, ["stratum"], "_key", bucket, cuts, few)
    folds = ends.groupBy("stratum").agg(F.collect_list(F.struct("_key", "cut")).alias("_ends"))
    open_folds = F.filter(F.col("_ends"), lambda e: e["_key"] >= F.col(idx))
    return (
        df.withColumn("stratum", F.col(stratify).cast("string"))
        .join(F.broadcast(folds) if few else folds, "stratum")
        .withColumn("fold", F.array_min(F.transform(open_folds, lambda e: e["cut"])).cast("int"))
        .drop("stratum", "_ends")
    )


def fold_sets(folded: DataFrame, k: int = config.N_SPLITS) -> DataFrame:
    """Every row once per fold, as `train` or `test` of `run_fold`."""
    runs = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    part = F.when(F.col("run_fold") == F.col("fold"), F.lit("test")).otherwise(F.lit("train"))
    return folded.withColumn("run_fold", runs).withColumn("part", part)
