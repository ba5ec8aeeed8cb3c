"""Nearest neighbours by Euclidean distance, every pair measured."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane import config
from lexivane.operators.topk import KEPT_BYTES, PLACES, Best, in_slices, rank_hits, scan_in_blocks, scan_with_queries
from lexivane.session import written

_BLOCK = 2_000_000
_TILE = 512  # queries whose bounds are held at once
_DOCS = 1024  # documents, too
_HELD = 100_000  # pairs kept to be measured
_EXACT = 8_000  # those measured at once
_ROUNDING = 2.0**-24  # of single precision
_LARGEST = 1e30  # squared length whose products single precision still holds
_TILE_BYTES = 64 << 20


def matrix(column: pa.Array | pa.ChunkedArray, number: type = np.float64) -> np.ndarray:
    """A column of equally long lists as a matrix; no rows give a 0 x 0 one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), number)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(number).reshape(len(column), -1)


@dataclass
class Queries:
    """Query vectors in a task: as they are, and less their centre in single precision with a 1 for the documents' squares.

    fit tells which of them single precision can hold; length is that of the centred vectors.
    """

    vectors: np.ndarray
    square: np.ndarray
    fit: np.ndarray
    centre: np.ndarray
    narrow: np.ndarray
    length: np.ndarray


def asked_for(vectors: np.ndarray) -> Queries:
    square = np.einsum("ij,ij->i", vectors, vectors)
    fit = square < _LARGEST
    centre = vectors[fit].mean(axis=0) if fit.any() else np.zeros(vectors.shape[1])
    narrow, length = np.ones((len(vectors), vectors.shape[1] + 1), np.float32), np.zeros(len(vectors))
    for at in range(0, len(vectors), _DOCS):
        part = slice(at, at + _DOCS)
        moved = np.where(fit[part, None], vectors[part] - centre, 0.0)
        narrow[part, :-1], length[part] = moved, np.linalg.norm(moved, axis=1)
    return Queries(vectors, square, fit, centre, narrow, length)


def _prepare(queries: pa.Table) -> tuple[np.ndarray, Queries]:
    return queries["query_idx"].to_numpy(), asked_for(matrix(queries["vector"]))


def offer(queries: Queries, which: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: Best) -> None:
    """Offer documents to some of the queries, scored by -distance.

    Products in single precision, with a bound of their error, leave most
    pairs out; the few that can still enter a top k are then measured exactly,
    rounded, and ranked. Queries without k documents yet first meet a few in
    double precision, as do vectors that single precision cannot hold.
    """
    if not (np.einsum("ij,ij->i", vectors, vectors) < _LARGEST).all():
        return _offer_double(queries, which, ids, vectors, best)
    fit = queries.fit[which]
    if not fit.all():
        _offer_double(queries, which[~fit], ids, vectors, best)
        which = which[fit]
    if np.isinf(best.floor[which]).any():
        head, ids, vectors = (ids[: 8 * best.k], vectors[: 8 * best.k]), ids[8 * best.k :], vectors[8 * best.k :]
        for at in range(0, len(which), _TILE):
            _offer_double(queries, which[at : at + _TILE], *head, best)
        if len(ids):
            best.compact()
    for at in range(0, len(ids), _DOCS):
        _offer_single(queries, which, ids[at : at + _DOCS], vectors[at : at + _DOCS], best)


def _offer_single(queries: Queries, which: np.ndarray, ids: np.ndarray, docs: np.ndarray, best: Best) -> None:
    moved = docs - queries.centre
    square = np.einsum("ij,ij->i", moved, moved)
    wide = np.empty((len(docs), docs.shape[1] + 1), np.float32)
    wide[:, :-1], wide[:, -1] = 2.0 * moved, -square
    length, far = queries.length[which], square.max()
    slack = 1e-12 * (queries.square[which] + np.einsum("ij,ij->i", docs, docs).max())
    error = 4 * (docs.shape[1] + 4) * _ROUNDING * (2 * length * np.sqrt(far) + far)
    # 2qd - dd is at least this where the distance can be within the bound.
    least = length**2 - (-best.floor[which] + 10.0**-PLACES) ** 2 - slack - error
    least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for at in range(0, len(which), _TILE):
        tile = which[at : at + _TILE]
        query, doc = np.divmod(np.flatnonzero(queries.narrow[tile] @ wide.T >= least[at : at + _TILE, None]), len(docs))
        found.append((tile[query], doc))
        held += len(doc)
        if held > _HELD or at + _TILE >= len(which):
            _measure(queries, *(np.concatenate(x) for x in zip(*found)), ids, docs, best)
            found, held = [], 0


def _offer_double(queries: Queries, which: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: Best) -> None:
    asked, asked_sq = queries.vectors[which], queries.square[which]
    step = max(1, _BLOCK // len(which))
    for at in range(0, len(ids), step):
        docs = vectors[at : at + step]
        doc_sq = np.einsum("ij,ij->i", docs, docs)
        square = asked_sq[:, None] + doc_sq[None, :] - 2.0 * (asked @ docs.T)
        worst = -best.floor[which]
        if len(docs) > best.k and np.isinf(worst).any():
            kth = np.partition(square, best.k - 1, axis=1)[:, best.k - 1]
            worst = np.minimum(worst, np.sqrt(np.maximum(kth, 0.0)))
        slack = 1e-12 * (asked_sq + doc_sq.max())
        bound = (worst + 10.0**-PLACES) ** 2 + slack
        query, doc = np.nonzero(square <= bound[:, None])
        _measure(queries, which[query], doc, ids[at : at + step], docs, best)


def _measure(queries: Queries, query: np.ndarray, doc: np.ndarray, ids: np.ndarray, docs: np.ndarray, best: Best) -> None:
    for part in range(0, len(query), _EXACT):
        q, d = query[part : part + _EXACT], doc[part : part + _EXACT]
        apart = queries.vectors[q]
        apart -= docs[d]
        apart *= apart
        best.add(q, ids[d], -np.round(np.sqrt(apart.sum(axis=1)), PLACES))


def _score_distance(queries: Queries, batch: pa.RecordBatch, best: Best) -> None:
    if batch.num_rows == 0 or not len(queries.vectors):
        return
    ids = batch.column("corpus_idx").to_numpy(zero_copy_only=False)
    offer(queries, np.arange(len(queries.vectors)), ids, matrix(batch.column("vector")), best)


def _sides(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    there = F.col("vector").isNotNull()
    return queries.select("query_idx", "vector").filter(there), corpus.select("corpus_idx", "vector").filter(there)


def _width(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.size("vector"))).first()[0] or 0


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = config.TOP_K,
    query_bytes: int = config.QUERY_BLOCK_BYTES,
    tile_bytes: int = _TILE_BYTES,
) -> DataFrame:
    """(query_idx, rank, corpus_idx, score): the k nearest documents, exactly.

    queries (query_idx, vector) and corpus (corpus_idx, vector); score is the
    distance. Rows without a vector, as a failed encoding leaves them, neither
    ask nor are found. Queries that fit in query_bytes go to every task, which scans its
    share of the corpus in place; more of them go there in blocks of that size, one
    after another. A task measures at most tile_bytes of the corpus at once.
    """
    queries, docs = _sides(queries, corpus)
    queries = written(queries, "queries")
    n_queries, width = queries.count(), _width(queries)
    row_bytes = 8 * width + 16
    query_row = row_bytes + KEPT_BYTES * k
    score = in_slices(_score_distance, max(1, tile_bytes // row_bytes))
    if n_queries * query_row <= query_bytes:
        hits = scan_with_queries(docs, queries.toArrow(), _prepare, score, k)
    else:
        hits = scan_in_blocks(written(docs, "docs"), queries, -(-n_queries * query_row // query_bytes), _prepare, score, k)
    return rank_hits(hits.withColumn("score", F.abs("score")), k, ascending=True)


def nearest_by_cells(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = config.TOP_K,
    cells: int | None = None,
    probes: int | None = None,
    seed: int = config.RANDOM_STATE,
    tile_rows: int = 2048,
    recall: float = 0.95,
) -> DataFrame:
    """Approximate nearest documents: exact within the cells of the nearest pivots.

    Without a number of cells there are as many as the root of the number of
    documents; without a number of probes a sample of the queries decides how
    many cells reach the recall. A query always gets k documents where there
    are as many. With probes = cells the result is exact. tile_rows documents
    of a cell are measured at once.
    """
    from lexivane.operators import cells as around  # which builds on this module

    queries, docs = _sides(queries, corpus)
    queries, placed = written(queries, "queries"), around.place(docs, cells, seed)
    if probes is None:
        probes = around.probes_for(queries, placed, k, recall, seed)
    return around.nearest_probed(queries, placed, probes, k, tile_rows)
