"""Accuracy over a whole grid of settings in one pass: widths, weights, vocabulary sizes and normalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane import config
from lexivane.functions import text
from lexivane.operators.encode import model_bytes
from lexivane.operators.knn import matrix
from lexivane.session import written

_SIDES = ("query", "positive", "negative")
_CELLS = 4_000_000
_PLACES = 6
_TOTALS = 7  # running sums of a setting: two squared distances, three squared lengths, two products


def _side_means(lists: pa.Array, tokens: pa.Array, table: np.ndarray, weights: np.ndarray, size_of: np.ndarray, n_sizes: int) -> np.ndarray:
    """Weighted mean vectors, weight x size x list x dimension; size_of is the first vocabulary size that holds a token."""
    n, width = len(lists), table.shape[1]
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    found = pc.index_in(lists.flatten(), value_set=tokens)
    row = np.repeat(np.arange(n), lengths)[found.is_valid().to_numpy(zero_copy_only=False)]
    token = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    row, token = row[size_of[token] < n_sizes], token[size_of[token] < n_sizes]
    pair, times = np.unique(row * max(1, len(tokens)) + token, return_counts=True)
    row, token = pair // max(1, len(tokens)), pair % max(1, len(tokens))
    place = size_of[token] * n + row
    order = np.argsort(place, kind="stable")
    place, token, times = place[order], token[order], times[order]
    sums = np.zeros((len(weights), n_sizes * n, width))
    step = max(1, _CELLS // max(1, width))
    for at in range(0, len(place), step):
        part = slice(at, at + step)
        starts = np.flatnonzero(np.diff(place[part], prepend=-1))
        rows = table[token[part]]
        for s, weight in enumerate(weights):
            sums[s, place[part][starts]] += np.add.reduceat(rows * (weight[token[part]] * times[part])[:, None], starts, axis=0)
    known = np.cumsum(np.bincount(place, times, n_sizes * n).reshape(n_sizes, n), axis=0)
    return np.cumsum(sums.reshape(len(weights), n_sizes, n, width), axis=1) / np.maximum(known, 1)[None, :, :, None]


def _totals(means: list[np.ndarray], dims: Sequence[int], running: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums at each of dims and at the end: kind x weight x size x list x dim."""
    q, p, n = means
    at = [int(d) - 1 for d in dims]
    out, last = [], []
    for place, values in enumerate(((q - p) ** 2, (q - n) ** 2, q * q, p * p, n * n, q * p, q * n)):
        upto = np.cumsum(values, axis=-1) + running[place][..., None]
        out.append(upto[..., at])
        last.append(upto[..., -1])
    return np.stack(out), np.stack(last)


def _nearer(totals: np.ndarray, normalize: Sequence[bool]) -> np.ndarray:
    """Predictions, list x weight x size x dim x normalize."""
    plain_p, plain_n, qq, pp, nn, qp, qn = totals
    lq, lp, ln = (np.sqrt(x) + config.L2_EPSILON for x in (qq, pp, nn))
    unit_p, unit_n = qq / lq**2 + pp / lp**2 - 2 * qp / (lq * lp), qq / lq**2 + nn / ln**2 - 2 * qn / (lq * ln)
    out = []
    for unit in normalize:
        a, b = (np.round(np.sqrt(np.maximum(x, 0.0)), _PLACES) for x in ((unit_p, unit_n) if unit else (plain_p, plain_n)))
        out.append(a < b)
    return np.moveaxis(np.stack(out, axis=-1), 2, 0)


def sweep(
    pairs: DataFrame,
    model: DataFrame,
    weights: DataFrame,
    dims: Sequence[int],
    sizes: Sequence[int],
    normalize: Sequence[bool] = (False,),
    tokenize: Callable[[Column], Column] = text.words,
    model_limit: int = config.BROADCAST_BYTES,
) -> DataFrame:
    """(idx, output_dim, sif, vocab_size, normalize, prediction) for every setting of the grid.

    pairs: idx, query, positive, negative. model: token_id (rank), token, vector; weights: sif, token_id, weight. A
    vector of the first d dimensions gives the distance at width d on the way to that of all, and a vocabulary of the
    first tokens is a part of the sums of a larger one; so texts are read and looked up once for the whole grid and
    only predictions leave the tasks. Rotate the model first to sweep over its components. A model beyond
    model_limit goes to the tasks by slices of its dimensions; rows then carry seven sums for each setting.
    """
    dims, sizes = sorted(dims), sorted(sizes)
    size, width = model_bytes(model)
    if not dims or dims[0] < 1 or dims[-1] > width:
        raise ValueError(f"dims must lie between 1 and {width}")
    grid = weights.select("sif").distinct().orderBy("sif").toArrow()["sif"].to_pylist()
    each = [F.max(F.when(F.col("sif") == F.lit(s), F.col("weight"))) for s in grid]
    held = weights.groupBy("token_id").agg(F.array(*each).alias("weight"))
    one = written(model.join(held, "token_id"), "swept-model")
    slices = max(1, -(-(size + 8 * len(grid) * one.count()) // max(1, model_limit)))
    edges = [round(i * dims[-1] / min(slices, dims[-1])) for i in range(min(slices, dims[-1]) + 1)]
    settings = len(grid) * len(sizes)
    sides = [tokenize(F.col(s)).alias(s) for s in _SIDES]
    rows = pairs.select("idx", *sides, F.array_repeat(F.lit(0.0), _TOTALS * settings).alias("running"), F.array().cast("array<int>").alias("made"))
    labels = []
    for low, high in zip(edges, edges[1:]):
        inside = [d for d in dims if low < d <= high]
        labels += [(s, v, d, u) for s in grid for v in sizes for d in inside for u in normalize]
        rows = _pass(rows, one, low, high, inside, grid, sizes, normalize)
        rows = written(rows, "swept") if high < dims[-1] else rows
    names = {"sif": 0, "vocab_size": 1, "output_dim": 2, "normalize": 3}
    found = rows.select("idx", F.posexplode("made").alias("_at", "prediction"))
    chosen = [F.array(*[F.lit(label[i]) for label in labels])[F.col("_at")].alias(name) for name, i in names.items()]
    return found.select("idx", *chosen, "prediction")


def _pass(rows: DataFrame, model: DataFrame, low: int, high: int, dims: list[int], grid: list, sizes: list, normalize: Sequence[bool]) -> DataFrame:
    cut = F.slice("vector", low + 1, high - low).alias("vector")
    table = model.select("token_id", "token", "weight", cut).toArrow()
    size_of = np.searchsorted(np.array(sizes), table["token_id"].to_numpy(), "right")
    packed = (table["token"].combine_chunks(), matrix(table["vector"], np.float32), matrix(table["weight"]).T.reshape(len(grid), -1), size_of)
    sent = rows.sparkSession.sparkContext.broadcast(packed)
    step = max(1, _CELLS // (len(grid) * len(sizes) * (high - low)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, vectors, weights, size_of = sent.value
        vectors = vectors.reshape(len(tokens), high - low)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                n = batch.num_rows
                means = [_side_means(batch.column(s), tokens, vectors, weights, size_of, len(sizes)) for s in _SIDES]
                running = np.moveaxis(matrix(batch.column("running")).reshape(n, _TOTALS, len(grid), len(sizes)), 0, -1)
                totals, last = _totals(means, [d - low for d in dims], running)
                made = _nearer(totals, normalize).reshape(n, -1).astype(np.int32)
                before = batch.column("made").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                told = [np.moveaxis(last, -1, 0).reshape(n, -1), np.hstack([before, made]).astype(np.int32)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in told]
                columns = [batch.column(c) for c in ("idx", *_SIDES)] + lists
                yield pa.RecordBatch.from_arrays(columns, names=["idx", *_SIDES, "running", "made"])

    return rows.mapInArrow(work, rows.schema)
