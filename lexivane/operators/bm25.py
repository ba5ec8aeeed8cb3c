"""BM25: the whole corpus ranked per query, and positive against negative."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane import config
from lexivane.functions import text
from lexivane.operators import shared
from lexivane.operators.topk import KEPT_BYTES, Best, in_slices, rank_hits, scan_in_blocks, scan_with_queries
from lexivane.session import sliced, small_batches, spread, written

_EXPAND = 500_000  # pairs of query and document scored at once
_BLOCK = 128  # documents that share bounds
_DENSE = 8_000_000  # numbers of the matrix of a block of queries
_TILE_TOKENS = 8_000_000
_AT_ONCE = 500_000  # tokens of documents that a task holds in arrays of numbers
_ROWS = 250  # triplets whose tokens a task holds as numbers
_PAIR_BYTES = 48


def corpus_statistics(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, df) and the one-row (n_docs, avgdl) of docs (corpus_idx, tokens)."""
    frequency = (
        docs.select(F.explode(F.array_distinct("tokens")).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    size = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("tokens")).alias("avgdl"))
    return frequency, size


def inverse_frequency(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def query_weights(queries: DataFrame, frequency: DataFrame, n_docs: int, k: int) -> DataFrame:
    """(query_idx, token, weight, share, rare): idf times the repeats of the query token, the share of documents with it, and whether it is rare.

    A token the corpus lacks drops out. A token most queries share makes a
    large group on the left of the join only, which adaptive execution splits.
    A query's rare tokens are its rarest, as many as k documents hold.
    """
    pairs = (
        queries.select("query_idx", F.explode("tokens").alias("token"))
        .groupBy("query_idx", "token")
        .agg(F.count(F.lit(1)).alias("repeats"))
    )
    idf = inverse_frequency(F.lit(n_docs), F.col("df"))
    upto = Window.partitionBy("query_idx").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, 0)
    rare = F.sum("df").over(upto) - F.col("df") < k
    return pairs.join(frequency, "token").select(
        "query_idx", "token", (F.col("repeats") * idf).alias("weight"), (F.col("df") / F.lit(n_docs)).alias("share"), rare.alias("rare")
    )


def counted(docs: DataFrame) -> DataFrame:
    """(corpus_idx, length, tokens, times): every token of docs (corpus_idx, tokens) once, and how often it is there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _ROWS):
            lists = batch.column("tokens")
            length = pc.list_value_length(lists)
            sizes = pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            n = max(1, len(coded.dictionary))
            key, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(len(sizes) + 1) * n).astype(np.int32))
            tokens = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(key % n)))
            columns = [batch.column("corpus_idx"), length, tokens, pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["corpus_idx", "length", "tokens", "times"])

    kind = docs.schema["corpus_idx"].dataType.simpleString()
    return docs.select("corpus_idx", "tokens").mapInArrow(work, f"corpus_idx {kind}, length int, tokens array<string>, times array<int>")


def _prepare(pairs: pa.Table) -> tuple[np.ndarray, shared.Asked]:
    return shared.prepare(pairs, _DENSE)


def _scorer(avgdl: float, k1: float, b: float, first: bool = False):
    def score(asked: shared.Asked, batch: pa.RecordBatch, best: Best) -> None:
        ids = batch.column("corpus_idx").to_numpy(zero_copy_only=False)
        tokens, lengths = batch.column("tokens"), batch.column("length").to_numpy(zero_copy_only=False)
        held = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
        found = pc.index_in(tokens.flatten(), value_set=asked.terms)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(ids)), held)[known]
        term = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = batch.column("times").flatten().to_numpy(zero_copy_only=False)[known]
        impact = tf / (tf + k1 * (1 - b + b * lengths[doc] / avgdl))
        # Documents of like length have like impacts, so that a block's greatest ones say more.
        size = 4 * _BLOCK if first else _BLOCK
        by_length = np.argsort(lengths, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[by_length] = np.arange(len(ids))
        ids, place, blocks = ids[by_length], place[doc], []
        order = np.argsort(place // size * max(1, len(asked.terms)) + term, kind="stable")
        place, term, impact = place[order], term[order], impact[order]
        for at in range(0, len(ids), size):
            some = slice(*np.searchsorted(place // size, [at // size, at // size + 1]))
            blocks.append(shared.block_of(asked, ids[at : at + size], term[some], place[some] - at, impact[some]))
        if first:
            for block in blocks:
                shared.first_round(asked, block, best)
            return
        bounds = shared.bounds(asked, blocks)
        for i, block in enumerate(blocks):
            shared.meet(asked, block, bounds[:, i], best, _EXPAND)

    return score


def search(
    queries: DataFrame,
    docs: DataFrame,
    k: int = config.TOP_K,
    k1: float = config.BM25_K1,
    b: float = config.BM25_B,
    query_bytes: int = config.QUERY_BLOCK_BYTES,
    tile_tokens: int = _TILE_TOKENS,
) -> DataFrame:
    """(query_idx, rank, corpus_idx, score) of the k best documents per query.

    queries (query_idx, tokens) and docs (corpus_idx, tokens). Only documents
    that share a token with the query are returned. Tokens are written once,
    since the statistics and the scoring both read them. A first round over some documents
    of every block tells a score that k documents reach. Weights that fit in
    query_bytes go to every task, more go there in blocks of that size, one
    after another. A task scores about tile_tokens tokens of documents at once, or fewer.
    """
    small_batches(docs.sparkSession)
    docs = spread(written(counted(docs), "tokens", "zstd"))
    frequency = docs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n_docs, avgdl = docs.agg(F.count(F.lit(1)), F.avg("length")).first()
    rows = max(1, int(min(tile_tokens, _AT_ONCE) / (avgdl or 1.0)))
    weights = written(query_weights(queries, frequency, n_docs, k), "weights")

    def scan(asked: DataFrame, first: bool) -> DataFrame:
        score = in_slices(_scorer(avgdl or 1.0, k1, b, first), rows)
        return scan_terms(docs, asked, _prepare, score, k, _PAIR_BYTES, query_bytes)

    return in_rounds(weights, scan, k)


def scan_terms(docs: DataFrame, asked: DataFrame, prepare, score, k: int, pair_bytes: int, query_bytes: int) -> DataFrame:
    """(query_idx, rank, corpus_idx, score) by terms of queries, written (query_idx, token, ...): sent at once or in blocks of query_bytes."""
    n_bytes = asked.count() * pair_bytes + asked.select("query_idx").distinct().count() * KEPT_BYTES * k
    if n_bytes <= query_bytes:
        return rank_hits(scan_with_queries(docs, asked.toArrow(), prepare, score, k), k)
    return rank_hits(scan_in_blocks(docs, asked, -(-n_bytes // query_bytes), prepare, score, k), k)


def in_rounds(terms: DataFrame, scan: Callable[[DataFrame, bool], DataFrame], k: int) -> DataFrame:
    """The k best by scan(terms, first), of queries' terms (query_idx, token, weight, share, rare).

    The k-th score of the first round goes to the second one as least.
    """
    found = scan(terms, True)
    least = written(found.filter(F.col("rank") == k).select("query_idx", F.col("score").alias("least")), "least")
    every = terms.drop("rare").join(least, "query_idx", "left").fillna(float("-inf"), ["least"])
    return scan(written(every, "asked"), False)


def tokenised(df: DataFrame, id_col: str, text_col: str, name: str, tokenize=text.words) -> DataFrame:
    """(name, tokens), the form search takes."""
    return df.select(F.col(id_col).alias(name), tokenize(F.col(text_col)).alias("tokens"))


_SIDES = ("query", "positive", "negative")


def _pair_terms(triplets: DataFrame, tokenize) -> DataFrame:
    """(idx, token, q, p, n): count of a token in query, positive and negative."""
    sides = F.explode(
        F.array(*[F.struct(F.lit(c).alias("side"), tokenize(F.col(c)).alias("tokens")) for c in _SIDES])
    )

    def times(side: str):
        return F.sum((F.col("side") == side).cast("bigint"))

    return (
        triplets.select("idx", sides.alias("_s"))
        .select("idx", "_s.side", F.explode("_s.tokens").alias("token"))
        .groupBy("idx", "token")
        .agg(times("query").alias("q"), times("positive").alias("p"), times("negative").alias("n"))
    )


def _row_terms(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(row, token code, q, p, n) of a batch, and the tokens by code."""
    lists = [batch.column(s) for s in _SIDES]
    coded = pa.chunked_array([x.flatten() for x in lists], pa.string()).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = [
        np.repeat(np.arange(len(x)), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)) for x in lists
    ]
    side = np.repeat(np.arange(3), [len(r) for r in row])
    key, place = np.unique(np.concatenate(row) * max(1, len(coded.dictionary)) + codes, return_inverse=True)
    times = np.bincount(place * 3 + side, minlength=3 * len(key)).reshape(-1, 3)
    return key // max(1, len(coded.dictionary)), key % max(1, len(coded.dictionary)), *times.T, coded.dictionary


def _score_rows(triplets: DataFrame, tokenize, score) -> DataFrame:
    """(idx, pos_score, neg_score, prediction): score(batch) gives both scores of rows of tokens, where the rows are.

    No text leaves its task. Scores are null and the prediction is -1 where a text is missing.
    """
    small_batches(triplets.sparkSession)
    there = F.col("positive").isNotNull() & F.col("negative").isNotNull()
    sides = [F.when(there, tokenize(F.col(s))).alias(s) for s in _SIDES]
    kind = triplets.schema["idx"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _ROWS):
            pos, neg = (pa.array(np.asarray(x, np.float64)) for x in score(batch))
            yield pa.RecordBatch.from_arrays([batch.column("idx"), batch.column("there"), pos, neg], names=["idx", "there", "pos", "neg"])

    scored = triplets.select("idx", there.alias("there"), *sides).mapInArrow(work, f"idx {kind}, there boolean, pos double, neg double")
    pos, neg = (F.when(F.col("there"), F.round(c, 6)) for c in ("pos", "neg"))
    won = F.when(F.col("there"), (F.round("pos", 6) > F.round("neg", 6)).cast("int")).otherwise(-1)
    return scored.select("idx", pos.alias("pos_score"), neg.alias("neg_score"), won.alias("prediction"))


def _missing(triplets: DataFrame, scored: DataFrame) -> DataFrame:
    """(idx, prediction, scores): -1 where a text is missing."""
    there = F.col("positive").isNotNull() & F.col("negative").isNotNull()
    zero = F.lit(0.0)
    return (
        triplets.select("idx", there.alias("_there"))
        .join(scored, "idx", "left")
        .withColumn("pos_score", F.when(F.col("_there"), F.round(F.coalesce(F.col("pos_score"), zero), 6)))
        .withColumn("neg_score", F.when(F.col("_there"), F.round(F.coalesce(F.col("neg_score"), zero), 6)))
        .select(
            "idx",
            "pos_score",
            "neg_score",
            F.when(F.col("_there"), (F.col("pos_score") > F.col("neg_score")).cast("int"))
            .otherwise(-1)
            .alias("prediction"),
        )
    )


def predict_pairs(
    triplets: DataFrame,
    tokenize=text.words,
    k1: float = config.BM25_K1,
    b: float = config.BM25_B,
    epsilon: float = config.OKAPI_EPSILON,
) -> DataFrame:
    """(idx, pos_score, neg_score, prediction) by Okapi over each row's own corpus.

    That corpus is the negative, the positive and a dummy document of five
    terms. 1 if the positive scores higher, 0 if not, -1 if a text is missing.
    """
    idf_of = {df: float(np.log(3 - df + 0.5) - np.log(df + 0.5)) for df in (1, 2)}
    dummies = config.OKAPI_DUMMY_TERMS

    def score(batch: pa.RecordBatch) -> list[np.ndarray]:
        rows = batch.num_rows
        row, _, q, p, n, _ = _row_terms(batch)
        held = (p > 0).astype(int) + (n > 0)
        single, double = (np.bincount(row[held == h], minlength=rows) for h in (1, 2))
        lengths = [np.bincount(row, times, rows) for times in (p, n)]
        common = ((single + dummies) * idf_of[1] + double * idf_of[2]) / (single + dummies + double) * epsilon
        mean = (lengths[0] + lengths[1] + dummies) / 3.0
        idf = np.where(held == 2, common[row], idf_of[1])
        out = []
        for tf, length in zip((p, n), lengths):
            norm = k1 * (1 - b + b * length / mean)
            out.append(np.bincount(row, np.where(held > 0, q * idf * tf * (k1 + 1) / np.where(tf > 0, tf + norm[row], 1.0), 0.0), rows))
        return out

    return _score_rows(triplets, tokenize, score)


def predict_pairs_global(
    triplets: DataFrame,
    docs: DataFrame,
    tokenize=text.words,
    k1: float = config.BM25_K1,
    b: float = config.BM25_B,
    send_bytes: int = config.BROADCAST_BYTES,
) -> DataFrame:
    """The same prediction with document frequencies of the whole corpus.

    Frequencies of the words that queries hold are sent to the rows up to
    send_bytes; beyond that the rows' words are joined with them.
    """
    frequency, size = corpus_statistics(docs)
    found = size.first()
    n_docs, mean = found["n_docs"], found["avgdl"] or 1.0
    asked = triplets.select(F.explode(tokenize(F.col("query"))).alias("token")).distinct()
    idf = inverse_frequency(F.lit(n_docs), F.col("df"))
    known = written(frequency.join(asked, "token", "left_semi").select("token", idf.alias("idf")), "asked-frequencies")
    if (known.agg(F.sum(F.octet_length("token") + 48)).first()[0] or 0) > send_bytes:
        return _predict_by_join(triplets, known, mean, tokenize, k1, b)
    table = known.toArrow()
    sent = triplets.sparkSession.sparkContext.broadcast((table["token"].combine_chunks(), table["idf"].to_numpy()))

    def score(batch: pa.RecordBatch) -> list[np.ndarray]:
        tokens, idf = sent.value
        row, code, q, p, n, words = _row_terms(batch)
        at = pc.fill_null(pc.index_in(words, value_set=tokens), -1).to_numpy(zero_copy_only=False)[code]
        weight = np.where(at >= 0, np.append(idf, 0.0)[at], 0.0) * q
        out = []
        for tf in (p, n):
            norm = k1 * (1 - b + b * np.bincount(row, tf, batch.num_rows) / mean)
            out.append(np.bincount(row, weight * tf / np.where(tf > 0, tf + norm[row], 1.0), batch.num_rows))
        return out

    return _score_rows(triplets, tokenize, score)


def _predict_by_join(triplets: DataFrame, known: DataFrame, mean: float, tokenize, k1: float, b: float) -> DataFrame:
    terms = _pair_terms(triplets.filter(F.col("positive").isNotNull() & F.col("negative").isNotNull()), tokenize)
    lengths = terms.groupBy("idx").agg(F.sum("p").alias("_pl"), F.sum("n").alias("_nl"))
    matched = terms.filter((F.col("q") > 0) & (F.col("p") + F.col("n") > 0)).join(known, "token")

    def part(tf: str, length: str):
        norm = k1 * (1 - b + b * F.col(length) / mean)
        return F.col("q") * F.col("idf") * F.col(tf) / (F.col(tf) + norm)

    scored = (
        matched.join(lengths, "idx")
        .groupBy("idx")
        .agg(F.sum(part("p", "_pl")).alias("pos_score"), F.sum(part("n", "_nl")).alias("neg_score"))
    )
    return _missing(triplets, scored)
