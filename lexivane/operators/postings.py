"""BM25 over a written postings table, in two rounds.

A row of the table is a block of documents: the tokens that occur in it, for each the documents and counts, and the greatest
impact that it has on any of them. The first round scores every query on the documents of each block that its rarest tokens have
the greatest impact on; the k-th of these scores is less than or equal to the k-th of all. The second round adds up, for a query and
a block, the greatest impacts of the query's tokens, and opens the block only for queries whose sum can still beat that score.

Blocks stay where they are; neither documents nor the postings of a token are moved, so a word that every document holds costs
each task its own part of it. Only queries go to the tasks, in blocks of checked size, one after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane import config
from lexivane.operators import shared
from lexivane.operators.bm25 import in_rounds, query_weights, scan_terms
from lexivane.operators.topk import Best, in_slices
from lexivane.session import new_path, small_batches, written

BLOCK_DOCS = 512
BLOCK_TOKENS = 500_000
_EXPAND = 500_000  # pairs of query and document scored at once
_DENSE = 8_000_000  # numbers of the matrix of a block of queries
_TERM_BYTES = 48
_TILE_BYTES = 64 << 20
_SCHEMA = "corpus_idx long, tokens array<string>, ends array<int>, most array<double>, docs binary, times binary, ids array<long>, lengths binary"


@dataclass
class Postings:
    """blocks as written, (token, df) over all of them, and the collection's size and mean length."""

    blocks: DataFrame
    frequency: DataFrame
    n_docs: int
    mean_length: float
    k1: float
    b: float


def _impact(times: np.ndarray, length: np.ndarray, mean: float, k1: float, b: float) -> np.ndarray:
    return times / (times + k1 * (1 - b + b * length / mean))


def build(docs: DataFrame, path: str | None = None, k1: float = config.BM25_K1, b: float = config.BM25_B, block_docs: int = BLOCK_DOCS) -> Postings:
    """Write the postings of docs (corpus_idx, tokens) under path, or in the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or new_path(spark, "postings")
    docs = written(docs.select("corpus_idx", "tokens"), "tokens", "zstd")
    n_docs, mean = docs.agg(F.count(F.lit(1)), F.avg(F.coalesce(F.size("tokens"), F.lit(0)))).first()
    mean = mean or 1.0

    def pack(ids: list, tokens: list, task: int, block: int) -> pa.RecordBatch:
        lists = pa.chunked_array(tokens, pa.list_(pa.string())).combine_chunks()
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        n = len(coded.dictionary)
        doc = np.repeat(np.arange(len(length)), length)
        pair, times = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(length) + doc, return_counts=True)
        term, doc = pair // max(1, len(length)), pair % max(1, len(length))
        ends = np.cumsum(np.bincount(term, minlength=n))
        impact = _impact(times, length[doc], mean, k1, b)
        most = np.maximum.reduceat(impact, np.concatenate([[0], ends[:-1]]).astype(np.int64)) if n else np.zeros(0)
        columns = [
            pa.array([(task << 32) + block]),
            pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())),
            pa.array([ends], pa.list_(pa.int32())),
            pa.array([most], pa.list_(pa.float64())),
            pa.array([doc.astype(np.uint32).tobytes()], pa.binary()),
            pa.array([times.astype(np.uint32).tobytes()], pa.binary()),
            pa.array([np.concatenate(ids)], pa.list_(pa.int64())),
            pa.array([length.astype(np.uint32).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["corpus_idx", "tokens", "ends", "most", "docs", "times", "ids", "lengths"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = TaskContext.get().partitionId(), 0
        ids: list = []
        tokens: list = []
        held = words = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                tokens.append(part.column(1))
                held += part.num_rows
                words += len(part.column(1).flatten())
                if held >= block_docs or words >= BLOCK_TOKENS:
                    yield pack(ids, tokens, task, block)
                    ids, tokens, held, words, block = [], [], 0, 0, block + 1
        if held:
            yield pack(ids, tokens, task, block)

    docs.mapInArrow(work, _SCHEMA).write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(_SCHEMA).parquet(f"{path}/blocks")
    ends = F.col("ends")
    each = F.explode(F.arrays_zip("tokens", F.zip_with(ends, F.concat(F.array(F.lit(0)), ends), lambda a, z: a - z).alias("n")))
    sized = blocks.select(each.alias("_t")).select("_t.*").toDF("token", "n").filter(F.col("token").isNotNull())
    sized.groupBy("token").agg(F.sum("n").cast("bigint").alias("df")).write.parquet(f"{path}/frequency")
    settings = [F.lit(n_docs).cast("long").alias("n_docs"), F.lit(mean).alias("mean_length"), F.lit(k1).alias("k1"), F.lit(b).alias("b")]
    spark.range(1).select(*settings).write.parquet(f"{path}/settings")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Postings:
    settings = spark.read.parquet(f"{path}/settings").first()
    frequency = spark.read.schema("token string, df long").parquet(f"{path}/frequency")
    return Postings(spark.read.schema(_SCHEMA).parquet(f"{path}/blocks"), frequency, *settings)


def _prepare(queries: pa.Table) -> tuple[np.ndarray, shared.Asked]:
    return shared.prepare(queries, _DENSE)


def _scorer(postings: Postings, first: bool, opened, met) -> Callable:
    mean, k1, b = postings.mean_length, postings.k1, postings.b

    def made(asked: shared.Asked, batch: pa.RecordBatch, at: int) -> shared.Block | None:
        row = {name: batch.column(name)[at] for name in ("tokens", "ends", "docs", "times", "ids", "lengths")}
        found = pc.index_in(row["tokens"].values, value_set=asked.terms)
        here = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        if not len(here):
            return None
        term = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(term)
        here, term = here[order], term[order]
        ends = row["ends"].values.to_numpy().astype(np.int64)
        first = np.concatenate([[0], ends[:-1]])[here]
        docs, times, lengths = (np.frombuffer(row[c].as_buffer(), np.uint32).astype(np.int64) for c in ("docs", "times", "lengths"))
        which, place = shared.spans(first, ends[here] - first)
        doc = docs[place]
        return shared.block_of(asked, row["ids"].values.to_numpy(), term[which], doc, _impact(times[place], lengths[doc], mean, k1, b))

    def score(asked: shared.Asked, batch: pa.RecordBatch, best: Best) -> None:
        for at in range(batch.num_rows):
            block = made(asked, batch, at)
            if block is None:
                continue
            if first:
                shared.first_round(asked, block, best)
            else:
                shared.meet(asked, block, shared.bounds(asked, [block])[:, 0], best, _EXPAND, False, opened, met)

    return score


def search(
    queries: DataFrame,
    postings: Postings,
    k: int = config.TOP_K,
    query_bytes: int = config.QUERY_BLOCK_BYTES,
    tile_blocks: int = 64,
    opened=None,
    met=None,
) -> DataFrame:
    """(query_idx, rank, corpus_idx, score) of the k best documents of queries (query_idx, tokens).

    The same as bm25.search. opened and met, Spark accumulators, are raised by the pairs of query and block that were
    scored, and by those that share a token.
    """
    terms = written(query_weights(queries, postings.frequency, postings.n_docs, k), "terms")

    def scan(asked: DataFrame, first: bool) -> DataFrame:
        score = in_slices(_scorer(postings, first, opened, met), tile_blocks)
        return scan_terms(postings.blocks, asked, _prepare, score, k, _TERM_BYTES, query_bytes)

    return in_rounds(terms, scan, k)
