"""Parquet tables for models, features, token maps and metrics."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.operators.encode import Encoder, encode_column

MODEL_SCHEMA = (
    T.StructType()
    .add("token_id", T.LongType())
    .add("token", T.StringType())
    .add("weight", T.DoubleType())
    .add("vector", T.ArrayType(T.FloatType()))
)
METRIC_SCHEMA = (
    T.StructType().add("run", T.StringType()).add("metric", T.StringType()).add("value", T.DoubleType())
)


def save_model(token_vectors: DataFrame, config: dict[str, str], path: str, mode: str = "errorifexists") -> None:
    """A static model: the token vectors and a one-row table of settings."""
    columns = [F.col(f.name).cast(f.dataType) for f in MODEL_SCHEMA]
    token_vectors.select(*columns).write.mode(mode).parquet(f"{path}/token_vectors")
    settings = [F.lit(str(value)).alias(name) for name, value in config.items()]
    token_vectors.sparkSession.range(1).select(*settings).write.mode(mode).parquet(f"{path}/model_config")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    vectors = spark.read.schema(MODEL_SCHEMA).parquet(f"{path}/token_vectors")
    return vectors, spark.read.parquet(f"{path}/model_config")


def save_features(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    features.write.mode(mode).partitionBy("split").parquet(path)


def load_features(spark: SparkSession, path: str, splits: Sequence[str] | None = None) -> DataFrame:
    """Features of some splits; the others' files are not read."""
    rows = spark.read.parquet(path)
    return rows if splits is None else rows.filter(F.col("split").isin(*splits))


def encode_and_save(
    df: DataFrame,
    path: str,
    encoder_factory: Callable[[], Encoder],
    in_col: str = "pair",
    key: str = "corpus_idx",
    batch_size: int = 32,
    chunk_size: int = 5000,
    files_per_commit: int = 64,
    encoder_key: str | None = None,
) -> DataFrame:
    """Encode what path does not hold yet, add it, and read all of it.

    Rows to encode are first laid down as files of chunk_size rows under `<path>-todo`, which a stream takes up,
    files_per_commit at a time. Each such step is one commit: a folder of path by the step's number, and one of
    `<path>-errors` with the rows the encoder could not take and its message. A run that was cut short, in a step
    too, goes on with the first step that was not committed and encodes nothing twice; the stream's progress
    lies under `<path>-progress` and belongs to the table. Rows that failed are tried again by the next call.
    """
    spark = df.sparkSession
    schema = T.StructType(df.schema.fields[:]).add("embedding", T.ArrayType(T.FloatType()))
    schema = schema.add("chunk", T.LongType())
    encoder_key = encoder_key or uuid.uuid4().hex
    todo = f"{path}-todo"

    def commit(rows: DataFrame, step: int) -> None:
        coded = encode_column(rows, in_col, "embedding", encoder_factory, batch_size, encoder_key).persist()
        there = F.col("embedding").isNotNull()
        kept = coded.filter(there).drop("embedding_error")
        kept = kept.withColumn("chunk", F.floor(F.col(key) / chunk_size).cast("bigint"))
        failed = coded.filter(~there).select(*df.columns, "embedding_error")
        failed.write.mode("overwrite").parquet(f"{path}-errors/commit={step}")
        kept.write.mode("overwrite").option("maxRecordsPerFile", chunk_size).parquet(f"{path}/commit={step}")
        coded.unpersist()

    def drain() -> None:
        staged = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_commit).parquet(todo)
        stream = staged.writeStream.foreachBatch(commit).option("checkpointLocation", f"{path}-progress")
        stream.trigger(availableNow=True).start().awaitTermination()

    if _existing(spark, todo, df.schema) is not None:
        drain()
    done = _existing(spark, path, schema)
    fresh = df if done is None else df.join(done.select(key), key, "left_anti").select(*df.columns)
    fresh.write.mode("append").option("maxRecordsPerFile", chunk_size).parquet(todo)
    drain()
    saved = _existing(spark, path, schema)
    return (spark.createDataFrame([], schema) if saved is None else saved).select(*schema.names)


def failed_rows(spark: SparkSession, path: str, key: str = "corpus_idx") -> DataFrame:
    """Rows that encode_and_save could not encode so far, once each, with the encoder's message."""
    failed = spark.read.parquet(f"{path}-errors").drop("commit").dropDuplicates([key])
    return failed.join(spark.read.parquet(path).select(key), key, "left_anti")


def _existing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


TOKEN_MAP = ["index", "text", "projection_x", "projection_y"]
COMPARED_MAP = [*TOKEN_MAP, "other_projection_x", "other_projection_y", "is_redundant", "only_in_other"]
DIFFERENCE_MAP = [*COMPARED_MAP, "diff_projection_x", "diff_projection_y"]


def save_token_map(tokens: DataFrame, path: str, columns: Sequence[str] = TOKEN_MAP, mode: str = "errorifexists") -> None:
    tokens.select(*columns).write.mode(mode).parquet(path)


def long_metrics(wide: DataFrame, run: str, by: Sequence[str] = ()) -> DataFrame:
    """(run, metric, value) from a table with one metric per column."""
    names = [c for c in wide.columns if c not in by]
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    label = F.concat_ws(".", F.lit(run), *[F.col(c).cast("string") for c in by])
    return wide.select(label.alias("run"), F.inline(rows))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append (run, metric, value); NaN and missing values are left out."""
    metrics.filter(~F.isnan("value") & F.col("value").isNotNull()).select("run", "metric", "value").write.mode(
        "append"
    ).parquet(path)


def append_parameters(spark: SparkSession, run: str, parameters: dict, path: str) -> None:
    """Append (run, parameter, value) with the values as text."""
    rows = F.array(*[F.struct(F.lit(k).alias("parameter"), F.lit(str(v)).alias("value")) for k, v in parameters.items()])
    spark.range(1).select(F.lit(run).alias("run"), F.inline(rows)).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str, metrics: Sequence[str] | None = None) -> DataFrame:
    """One row per run, one column per metric."""
    rows = spark.read.schema(METRIC_SCHEMA).parquet(path)
    return rows.groupBy("run").pivot("metric", list(metrics) if metrics else None).agg(F.max("value"))
