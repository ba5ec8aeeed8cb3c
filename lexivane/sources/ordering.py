"""Dense row numbers and rank cut-offs without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivane.session import written


def free_names(columns: Sequence[str], *names: str) -> list[str]:
    """Names for helper columns beside the given ones."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def dense_index(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str = "idx",
    range_key: Column | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Add 0..n-1 in the given order, of columns of any type that sorts.

    Rows are dealt by ranges of the order, sorted there and written with their
    partition and place, so each is moved once and numbered by adding the size
    of the partitions before its own. Rows that tie are told apart by a hash of
    all their columns and by their place in the input, so that a key which many
    rows share is spread too. range_key replaces the order for dealing; it must
    never fall along it. rows_per_bucket sets how many rows a partition gets;
    by default there are as many partitions as the session shuffles into.
    """
    spark = df.sparkSession
    tie, source, place, part, start = free_names([*df.columns, name], "tie", "source", "place", "part", "start")
    hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    marked = df.withColumns({tie: F.xxhash64(*hashed) if hashed else F.lit(0), source: F.monotonically_increasing_id()})
    ranges = [*(order if range_key is None else [range_key]), tie, source]
    if rows_per_bucket:
        dealt = marked.repartitionByRange(max(1, -(-df.count() // rows_per_bucket)), *ranges)
    else:
        dealt = marked.repartitionByRange(*ranges)
    dealt = dealt.sortWithinPartitions(*order, tie, source).drop(tie, source)
    placed = written(dealt.withColumn(place, F.monotonically_increasing_id()), "ordered", "zstd")
    # The upper bits of a place number the partition, the lower 33 the row in it.
    number = F.shiftrightunsigned(F.col(place), 33)
    sizes = placed.groupBy(number.alias(part)).agg(F.count(F.lit(1)).alias("n")).orderBy(part).collect()  # one row a partition
    starts, done = [], 0
    for size in sizes:
        starts.append((size[part], done - (size[part] << 33)))
        done += size["n"]
    offsets = spark.createDataFrame(starts, f"{part} bigint, {start} bigint")
    joined = placed.withColumn(part, number).join(F.broadcast(offsets), part)
    return joined.withColumn(name, F.col(place) + F.col(start)).drop(place, part, start)


def sums_before(df: DataFrame, order: Sequence[str | Column], value: str, name: str, block_rows: int = 65_536) -> DataFrame:
    """Add the sum of value over all rows that come before in the order, 0 for the first.

    Rows are numbered, summed per block of the numbers, and the blocks' sums are
    added up; only those, one row a block, meet in one task.
    """
    place, block, start = free_names([*df.columns, name], "at", "block", "start")
    placed = dense_index(df, order, place).withColumn(block, F.floor(F.col(place) / block_rows))
    sums = placed.groupBy(block).agg(F.sum(value).alias("sum"))
    blocks = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    rows = Window.partitionBy(block).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(block, F.coalesce(F.sum("sum").over(blocks), F.lit(0)).alias(start))
    inside = F.coalesce(F.sum(value).over(rows), F.lit(0))
    return placed.join(starts, block).withColumn(name, F.col(start) + inside).select(*df.columns, name)


def source_index(spark: SparkSession, path: str, condition: Column | None = None, name: str = "idx", block_rows: int = 65_536) -> DataFrame:
    """Rows of Parquet files that meet a condition, numbered 0..n-1 as they stand: files by path, rows by place.

    Needs no key and no sort of the table. Rows are counted per block of a file;
    a row's number is its place among those kept in its block, plus the rows in the
    blocks before. Without a condition a row's place in its file is known, and
    only the files' sizes are added up.
    """
    rows = spark.read.parquet(path)
    file, row, block, start = free_names([*rows.columns, name], "file", "row", "block", "start")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    placed = rows.select(*columns, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    placed = placed if condition is None else placed.filter(condition)
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    if condition is None:
        files = placed.groupBy(file).agg(F.count(F.lit(1)).alias("n"))
        starts = files.select(file, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))  # one row a file
        numbered = placed.join(starts, file).withColumn(name, F.col(start) + F.col(row))
    else:
        placed = placed.withColumn(block, F.floor(F.col(row) / block_rows))
        sizes = written(placed.groupBy(file, block).agg(F.count(F.lit(1)).alias("n")), "blocks")
        files = sizes.groupBy(file).agg(F.sum("n").alias("n"))
        whole = files.select(file, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("whole"))  # one row a file
        inside = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(whole, file)
        starts = starts.select(file, block, (F.col("whole") + F.col("inside")).alias(start))
        place = F.row_number().over(Window.partitionBy(file, block).orderBy(row)) - 1
        numbered = placed.join(starts, [file, block]).withColumn(name, F.col(start) + place)
    return numbered.select(*columns, F.col(name).cast("bigint").alias(name))


def keys_at_ranks(
    df: DataFrame, groups: Sequence[str], key: str, bucket: Column, cuts: DataFrame, few: bool = False
) -> DataFrame:
    """The key found at given 1-based ranks of each group, in key order.

    cuts holds the group columns, a label `cut` and a `rank`. Only bucket
    counts are shuffled, then the rows of the buckets a rank falls in.
    bucket must never fall as key grows. few says that the caller has checked
    the cuts to be few enough to send to every task.
    """
    groups = list(groups)
    placed = df.select(*groups, key, bucket.alias("_bucket"))
    before = (
        Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = (
        placed.groupBy(*groups, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    hit = (F.col("_before") < F.col("rank")) & (F.col("rank") <= F.col("_before") + F.col("_n"))
    wanted = sizes.join(cuts, groups).filter(hit).select(*groups, "_bucket", "cut", "rank", "_before")
    inside = F.row_number().over(Window.partitionBy(*groups, "cut").orderBy(key))
    return (
        placed.join(F.broadcast(wanted) if few else wanted, [*groups, "_bucket"])
        .withColumn("_at", F.col("_before") + inside)
        .filter(F.col("_at") == F.col("rank"))
        .select(*groups, "cut", key)
    )
