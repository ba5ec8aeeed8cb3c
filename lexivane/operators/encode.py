"""Encoders: static token vectors, and any batch encoder."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane import config
from lexivane.functions import text, vectors
from lexivane.operators.knn import matrix
from lexivane.session import sliced, small_batches, written
from lexivane.sources.ordering import free_names

_CELLS = 100_000  # numbers of token vectors gathered at once: few enough to stay in the cache
_ROWS = 250  # texts whose tokens a task holds as numbers
_LEAST_PART = 1 << 20  # bytes of a model that are sent at once, also where nothing should be


def model_bytes(model: DataFrame) -> tuple[int, int]:
    """Size in bytes and vector width of a model (token, vector), with numbers as wide as its own."""
    rows, width = model.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    return rows * (_number(model).itemsize * (width or 0) + 40), width or 0


def _number(model: DataFrame) -> np.dtype:
    return np.dtype(np.float32 if model.schema["vector"].dataType.elementType == T.FloatType() else np.float64)


def _sum_vectors(lists: pa.Array, tokens: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the known tokens' vectors for each list, and how many tokens were known."""
    n, (n_tokens, width) = len(lists), table.shape
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    found = pc.index_in(lists.flatten(), value_set=tokens)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), lengths)[known]
    token = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    pair, times = np.unique(row * n_tokens + token, return_counts=True)
    row_of, token_of = pair // max(1, n_tokens), pair % max(1, n_tokens)
    sums = np.zeros((n, width))
    step = max(1, _CELLS // max(1, width))
    for at in range(0, len(pair), step):
        part = slice(at, at + step)
        rows = row_of[part]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        weighted = table[token_of[part]] * times[part, None]
        sums[rows[starts]] += np.add.reduceat(weighted, starts, axis=0)
    return sums, np.bincount(row, minlength=n)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), pa.float64()))


def _mean_vectors(lists: pa.Array, tokens: pa.Array, table: np.ndarray, normalize: bool) -> pa.Array:
    """Mean of the known tokens' vectors for each list; zero where none is."""
    sums, known = _sum_vectors(lists, tokens, table)
    means = sums / np.maximum(known, 1)[:, None]
    if normalize:
        means /= np.linalg.norm(means, axis=1, keepdims=True) + config.L2_EPSILON
    return _lists(means)


Specs = dict[str, tuple[str, DataFrame]]


def encode_columns(
    df: DataFrame,
    specs: Specs,
    normalize: bool = False,
    tokenize: Callable[[Column], Column] = text.words,
    model_limit: int = config.BROADCAST_BYTES,
) -> DataFrame:
    """Add the mean token vector of text columns.

    specs maps each new column to (text column, model); a model holds
    (token, vector). Models that together fit in model_limit go to every task;
    the others go there in parts of that size, one after another. Either way
    rows are encoded where they are, without a shuffle, and get the same vectors.
    """
    small_batches(df.sparkSession)
    models: dict[int, tuple] = {}
    small: Specs = {}
    large: dict = {}
    free = model_limit
    for out, (source, model) in specs.items():
        if id(model) not in models:
            size, width = model_bytes(model)
            sent = None
            if size <= free:
                free -= size
                sent = _send(df, model)
            models[id(model)] = (sent, width, size)
        sent, width, size = models[id(model)]
        if sent is None:
            large[out] = (source, model, width, max(2, -(-size // max(_LEAST_PART, model_limit))))
        else:
            small[out] = (source, sent)
    names = [*df.columns, *specs]
    for out, (source, model, width, parts) in large.items():
        df = _encode_by_parts(df, out, source, model, width, parts, normalize, tokenize)
    return (_encode_in_place(df, small, normalize, tokenize) if small else df).select(*names)


def _send(df: DataFrame, model: DataFrame) -> Broadcast:
    rows = model.select("token", "vector").toArrow()
    pair = (rows["token"].combine_chunks(), matrix(rows["vector"], _number(model)))
    return df.sparkSession.sparkContext.broadcast(pair)


def _encode_in_place(df: DataFrame, specs: dict, normalize: bool, tokenize) -> DataFrame:
    sources = sorted({source for source, _ in specs.values()})
    keep = [c for c in df.columns]
    fed = df.select(*keep, *[tokenize(F.col(s)).alias(f"_tokens_{s}") for s in sources])
    schema = T.StructType(df.schema.fields[:])
    for out in specs:
        schema = schema.add(out, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _ROWS):
            columns = [batch.column(name) for name in keep]
            for source, sent in specs.values():
                tokens, table = sent.value
                columns.append(_mean_vectors(batch.column(f"_tokens_{source}"), tokens, table, normalize))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *specs])

    return fed.mapInArrow(run, schema)


def _encode_by_parts(
    df: DataFrame, out: str, source: str, model: DataFrame, width: int, parts: int, normalize: bool, tokenize
) -> DataFrame:
    """Mean over a model that is too large to send, one part of its tokens at a time.

    Rows stay where they are. Each pass sends one part of the model, adds the vectors of the tokens it holds to the
    rows' sums, and is written; so a token that nearly all rows hold costs no more than any other.
    """
    total, known, tokens = free_names([*df.columns, out], "sum", "known", "tokens")
    zero = F.array_repeat(F.lit(0.0), width)
    df = df.withColumns({total: zero, known: F.lit(0).cast("bigint")})
    model = written(model.select("token", "vector"), "large-model")
    names = df.columns
    for part in range(parts):
        sent = _send(df, model.filter(F.pmod(F.xxhash64("token"), F.lit(parts)) == part))

        def add(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            value_set, table = sent.value
            table = table.reshape(len(value_set), width)
            for batch in sliced(batches, _ROWS):
                columns = {name: batch.column(name) for name in names}
                sums, n = _sum_vectors(batch.column(tokens), value_set, table)
                before = matrix(columns[total]).reshape(sums.shape) if width else sums
                columns[total] = _lists(before + sums)
                columns[known] = pa.array(columns[known].to_numpy() + n)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

        df = written(df.withColumn(tokens, tokenize(F.col(source))).mapInArrow(add, df.schema), "partly-encoded")
    value = F.transform(total, lambda x: x / F.greatest(F.col(known), F.lit(1)))
    return df.withColumn(out, vectors.unit(value) if normalize else value).drop(total, known)


Encoder = Callable[[list], Sequence]


def _kept_encoder(key: str, factory: Callable[[], Encoder]) -> Encoder:
    """The worker's encoder of that key, made when a task first asks for it. A worker holds one; another key replaces it."""
    # The package's own modules come anew with every task; this one stays in the worker.
    home = sys.modules.setdefault("lexivane_kept", types.ModuleType("lexivane_kept"))
    held = home.__dict__.setdefault("encoders", {})
    if key not in held:
        held.clear()
        held[key] = factory()
    return held[key]


def _float_lists(made: list) -> pa.Array:
    """Vectors, or None, as lists of single precision in one buffer."""
    none = np.array([v is None for v in made], bool)
    ends = np.cumsum([0 if v is None else len(v) for v in made])
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    flat = np.concatenate([v for v in made if v is not None]) if not none.all() else np.zeros(0, np.float32)
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32()), mask=pa.array(none))


def encode_column(
    df: DataFrame,
    in_col: str,
    out_col: str,
    encoder_factory: Callable[[], Encoder],
    batch_size: int = 1000,
    encoder_key: str | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Run a batch encoder over a text column, or a column of pairs.

    The factory is called once per Python worker, which keeps the encoder for all its tasks, and returns a function from a list
    of texts (or [instruction, text] pairs) to as many vectors. Calls with one encoder_key share the encoder; by
    default each call has its own. profile asks for executors with the resources that the encoder needs, such as
    accelerators. A batch that fails is retried row by row; a row that fails gets a null vector and its message in
    `<out_col>_error`.
    """
    keep = df.columns
    key = encoder_key or uuid.uuid4().hex
    error_col = f"{out_col}_error"
    schema = T.StructType(df.schema.fields[:]).add(out_col, T.ArrayType(T.FloatType())).add(error_col, T.StringType())

    def attempt(encode: Encoder, items: list) -> tuple[list, list]:
        try:
            made = [np.asarray(v, np.float32) for v in encode(items)]
            if len(made) != len(items):
                raise ValueError("the encoder must return one vector per text")
            return made, [None] * len(items)
        except Exception as error:
            if len(items) == 1:
                return [None], [f"{type(error).__name__}: {error}"]
            parts = [attempt(encode, [item]) for item in items]
            return [p[0][0] for p in parts], [p[1][0] for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _kept_encoder(key, encoder_factory)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                items = part.column(in_col).to_pylist()
                if items and isinstance(items[0], dict):
                    items = [[item["instruction"], item["text"]] for item in items]
                made, errors = attempt(encode, items)
                columns = [part.column(name) for name in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, _float_lists(made), pa.array(errors, pa.string())], names=[*keep, out_col, error_col]
                )

    return df.mapInArrow(run, schema, profile=profile)


def explode_tokens(df: DataFrame, key: Sequence[str], source: str, model: DataFrame, tokenize=text.words) -> DataFrame:
    """One row per (text, position, known token) with its vector and length."""
    tokens = df.select(*key, F.posexplode(tokenize(F.col(source))).alias("position", "token"))
    known = model.select("token", vectors.doubles(F.col("vector")).alias("vector"))
    return tokens.join(known, "token").withColumn("l2_norm", vectors.l2_norm(F.col("vector")))
