import math
from collections import Counter

import numpy as np
import pytest

from lexivane.operators import bm25, fusion, knn


def vectors(spark, matrix, name):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, vector array<double>").repartition(3)


def lists(ranked):
    got = {}
    for r in ranked.orderBy("query_idx", "rank").collect():
        got.setdefault(r["query_idx"], []).append((r["corpus_idx"], r["score"]))
    return got


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    docs = rng.normal(size=(120, 6))
    docs[40:80] = docs[40]  # a third of the corpus is one document
    queries = np.vstack([rng.normal(size=(9, 6)), docs[40], docs[3]])
    return queries, docs


def brute(queries, docs, k):
    far = np.round(np.sqrt(((queries[:, None] - docs[None]) ** 2).sum(-1)), 6)
    return {q: [(int(d), far[q, d]) for d in np.lexsort((np.arange(len(docs)), far[q]))[:k]] for q in range(len(queries))}


@pytest.mark.parametrize("query_bytes,tile_bytes", [(1 << 20, 1 << 20), (256, 2000)])
def test_nearest_is_exact(spark, points, query_bytes, tile_bytes):
    queries, docs = points
    got = knn.nearest(vectors(spark, queries, "query_idx"), vectors(spark, docs, "corpus_idx"), 7, query_bytes, tile_bytes)
    assert lists(got) == brute(queries, docs, 7)


def test_nearest_with_fewer_documents_than_k(spark, points):
    queries, docs = points
    got = knn.nearest(vectors(spark, queries, "query_idx"), vectors(spark, docs[:4], "corpus_idx"), 7)
    assert lists(got) == brute(queries, docs[:4], 7)


def test_cells_are_exact_when_all_are_probed_and_true_when_not(spark, points):
    queries, docs = points
    q, d = vectors(spark, queries, "query_idx"), vectors(spark, docs, "corpus_idx")
    exact = brute(queries, docs, 5)
    assert lists(knn.nearest_by_cells(q, d, 5, cells=4, probes=4, tile_rows=6)) == exact
    everything = brute(queries, docs, len(docs))
    some = lists(knn.nearest_by_cells(q, d, 5, cells=4, probes=2, tile_rows=6))
    for query, found in some.items():
        assert set(found) <= set(everything[query])
        assert [s for _, s in found] == sorted(s for _, s in found)


def tokens(spark, texts, name):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], f"{name} bigint, tokens array<string>").repartition(3)


@pytest.fixture(scope="module")
def collection():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(30)]
    weights = 1 / np.arange(1, 31)
    weights /= weights.sum()
    docs = [" ".join(["the"] + list(rng.choice(words, size=rng.integers(0, 25), p=weights))) for _ in range(90)]
    docs[30:60] = [docs[30]] * 30
    queries = [" ".join(["the", "the"] + list(rng.choice(words, size=4, p=weights))) for _ in range(40)] + ["unseen", "w1 w1 unseen"]
    return queries, docs


def brute_bm25(queries, docs, k):
    split = [Counter(d.split()) for d in docs]
    length = [sum(c.values()) for c in split]
    mean = sum(length) / len(docs)
    df = Counter(t for c in split for t in c)
    out = {}
    for q, query in enumerate(queries):
        scored = []
        for d, c in enumerate(split):
            s = 0.0
            for t in query.split():
                if c[t]:
                    idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                    s += idf * c[t] / (c[t] + 1.5 * (0.25 + 0.75 * length[d] / mean))
            if s > 0:
                scored.append((-round(s, 6), d))
        if scored:
            out[q] = [(d, -s) for s, d in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("query_bytes,tile_tokens", [(1 << 20, 10**6), (400, 300)])
def test_bm25_is_exact(spark, collection, query_bytes, tile_tokens):
    queries, docs = collection
    got = bm25.search(tokens(spark, queries, "query_idx"), tokens(spark, docs, "corpus_idx"), 8, query_bytes=query_bytes, tile_tokens=tile_tokens)
    assert lists(got) == brute_bm25(queries, docs, 8)


def test_bm25_in_small_blocks(spark, collection, monkeypatch):
    monkeypatch.setattr(bm25, "_EXPAND", 50)
    monkeypatch.setattr(bm25, "_DENSE", 90)
    queries, docs = collection
    got = bm25.search(tokens(spark, queries, "query_idx"), tokens(spark, docs, "corpus_idx"), 8)
    assert lists(got) == brute_bm25(queries, docs, 8)


def test_pair_prediction(spark):
    rows = [
        (0, "CAT", "CAT CAT CAT CAT ", "This is not it here either longer text"),
        (1, "cat", "dog", "cat"),
        (2, "cat", "cat", "cat"),
        (3, "cat", None, "cat"),
        (4, "nothing", "cat", "dog"),
    ]
    df = spark.createDataFrame(rows, "idx bigint, query string, positive string, negative string")
    got = {r["idx"]: r["prediction"] for r in bm25.predict_pairs(df).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: -1, 4: 0}
    docs = tokens(spark, ["cat dog", "cat", "dog tree"], "corpus_idx")
    whole = {r["idx"]: r["prediction"] for r in bm25.predict_pairs_global(df, docs).collect()}
    assert whole[1] == 0 and whole[3] == -1


def ranked(spark, rows):
    flat = [(q, rank, d, 0.0) for q, docs in rows.items() for rank, d in enumerate(docs, 1)]
    return spark.createDataFrame(flat, "query_idx bigint, rank bigint, corpus_idx bigint, score double")


def test_fusion(spark):
    a, b = ranked(spark, {0: [1, 2, 3]}), ranked(spark, {0: [3, 4], 1: [9]})
    fused = lists(fusion.reciprocal_rank_fusion([a, b]))
    assert [d for d, _ in fused[0]] == [3, 1, 2, 4] and [d for d, _ in fused[1]] == [9]
    assert fused[0][0][1] == pytest.approx(1 / 63 + 1 / 61, abs=1e-9)
    assert {d for d, _ in lists(fusion.reciprocal_rank_fusion([b, a]))[0]} == {1, 2, 3, 4}
    assert len(lists(fusion.reciprocal_rank_fusion([a, b], top_k=2))[0]) == 2


def test_overlap_divides_by_the_threshold(spark):
    queries = spark.createDataFrame([(0,), (1,)], "query_idx bigint")
    a, b = ranked(spark, {0: [1, 2, 3, 4]}), ranked(spark, {0: [2, 9, 1]})
    got = fusion.overlap(queries, a, b, [1, 2, 4, 10]).orderBy("query_idx").collect()
    assert tuple(got[0])[1:] == (0.0, 0.5, 0.5, 0.2) and tuple(got[1])[1:] == (0.0,) * 4
    assert fusion.mean_overlap(fusion.overlap(queries, a, b, [2]), [2]).first()[0] == 0.25


def test_rerank(spark):
    candidates = ranked(spark, {0: [0, 1, 2]})
    queries = vectors(spark, [[1.0, 0.0]], "query_idx")
    docs = vectors(spark, [[0.1, 9.0], [0.9, 0.0], [0.9, 5.0]], "corpus_idx")
    assert lists(fusion.rerank(candidates, queries, docs, 2))[0] == [(1, 0.9), (2, 0.9)]


@pytest.mark.parametrize(
    "gold,found,thresholds,want",
    [
        (42, [42, 10, 20, 30, 40, 50, 60, 70, 80, 90], [5, 10], (1, 1)),
        (99, [1, 2, 3, 4, 5, 6, 7, 99, 9, 10], [5, 10], (0, 1)),
        (999, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [5, 10], (0, 0)),
        (50, [1, 10, 50], [1, 2, 3], (0, 0, 1)),
        (None, [1, 2], [1, 2], (0, 0)),
    ],
)
def test_recall(spark, gold, found, thresholds, want):
    queries = spark.createDataFrame([(0, gold)], "query_idx bigint, corpus_idx bigint")
    got = fusion.recall_by_query(queries, ranked(spark, {0: found}), thresholds).first()
    assert tuple(got)[2:] == want and got["answerable"] is (gold is not None)


def test_mean_recall_counts_unanswerable_queries_as_misses(spark):
    queries = spark.createDataFrame([(0, 1), (1, None)], "query_idx bigint, corpus_idx bigint")
    recalls = fusion.recall_by_query(queries, ranked(spark, {0: [1], 1: [5]}), [1])
    got = {r["metric"]: r["value"] for r in fusion.mean_recall(recalls, [1]).collect()}
    assert got == {"recall_at_1": 0.5, "recall_answerable_at_1": 1.0}
