"""Scores by shared terms: blocks stay closed to queries that they can't serve, and few pairs are added up one by one."""

import numpy as np
import pyarrow as pa

from lexivane.operators import bm25, shared, topk


def searched(weights, impacts, k, least=None, pairs=400, size=16):
    """The k best by shared.meet, blocks of `size` documents, of queries x terms and documents x terms."""
    n_queries, n_terms = weights.shape
    query, term = np.nonzero(weights)
    table = {"query_idx": query, "token": [f"t{t}" for t in term], "weight": weights[query, term], "share": (impacts > 0).mean(axis=0)[term]}
    if least is not None:
        table["least"] = least[query]
    ids, asked = shared.prepare(pa.table(table), 6 * n_queries)
    best, code = topk.Best(len(ids), k), {t: i for i, t in enumerate(asked.terms.to_pylist())}
    opened = []
    for at in range(0, len(impacts), size):
        term, doc = np.nonzero(impacts[at : at + size].T)
        known = np.array([f"t{t}" in code for t in term], bool)
        term, doc = term[known], doc[known]
        coded = np.array([code[f"t{t}"] for t in term], np.int64)
        order = np.argsort(coded, kind="stable")
        block = shared.block_of(asked, np.arange(len(impacts))[at : at + size], coded[order], doc[order], impacts[at + doc, term][order])
        shared.meet(asked, block, shared.bounds(asked, [block])[:, 0], best, pairs, opened=type("Count", (), {"add": staticmethod(opened.append)}))
    query, doc, score = best.compact()
    return {int(ids[q]): list(zip(doc[query == q].tolist(), score[query == q].tolist())) for q in range(len(ids))}, sum(opened), asked


def brute(weights, impacts, k):
    out = {}
    for q in np.flatnonzero(weights.any(axis=1)):
        score = impacts @ weights[q]
        order = np.lexsort((np.arange(len(score)), -np.round(score, topk.PLACES)))[:k]
        out[int(q)] = [(int(d), round(float(score[d]), topk.PLACES)) for d in order if score[d] > 0]
    return out


def collection(seed):
    rng = np.random.default_rng(seed)
    share = np.r_[0.9, 0.7, 0.5, np.full(60, 0.04)]
    weights = (rng.random((90, 63)) < share * 0.8) * rng.uniform(0.5, 4, 63) * rng.integers(1, 3, (90, 63))
    impacts = (rng.random((400, 63)) < share) * rng.uniform(0.1, 0.9, (400, 63))
    impacts[100:180] = impacts[100]  # ties
    return weights, impacts


def same(got, want):
    return got.keys() == want.keys() and all([d for d, _ in got[q]] == [d for d, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-9) for q in want)


def test_equal_to_brute_force_with_columns_and_postings():
    for seed in range(4):
        weights, impacts = collection(seed)
        got, _, asked = searched(weights, impacts, 7)
        assert asked.narrow.shape[1] and len(asked.query)
        assert same(got, brute(weights, impacts, 7))


def test_known_scores_close_blocks():
    weights, impacts = collection(9)
    want = brute(weights, impacts, 3)
    least = np.array([want[q][2][1] if q in want and len(want[q]) == 3 else -np.inf for q in range(len(weights))])
    got, opened, _ = searched(weights, impacts, 3, least)
    _, all_opened, _ = searched(weights, impacts, 3)
    assert same(got, want) and opened < 0.7 * all_opened


def test_first_round_finds_scores_that_k_documents_reach():
    weights, impacts = collection(5)
    query, term = np.nonzero(weights)
    table = pa.table({"query_idx": query, "token": [f"t{t}" for t in term], "weight": weights[query, term], "share": (impacts > 0).mean(axis=0)[term], "rare": term > 2})
    ids, asked = shared.prepare(table, 6 * len(weights))
    code = {t: i for i, t in enumerate(asked.terms.to_pylist())}
    term, doc = np.nonzero(impacts.T * weights.any(axis=0)[:, None])
    coded = np.array([code[f"t{t}"] for t in term])
    order = np.argsort(coded, kind="stable")
    best = topk.Best(len(ids), 5)
    shared.first_round(asked, shared.block_of(asked, np.arange(len(impacts)), coded[order], doc[order], impacts[doc, term][order]), best)
    query, doc, score = best.compact()
    full = np.round(impacts @ weights.T, topk.PLACES)
    assert len(query) and np.allclose(score, full[doc, ids[query]], atol=1e-9)
    assert (impacts[doc, 3:] * weights[ids[query], 3:]).any(axis=1).all()


def test_tokens_are_counted_where_they_are(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["c"])]
    got = bm25.counted(spark.createDataFrame(rows, "corpus_idx bigint, tokens array<string>").coalesce(1)).collect()
    assert {r["corpus_idx"]: (r["length"], dict(zip(r["tokens"], r["times"]))) for r in got} == {1: (3, {"a": 1, "b": 2}), 2: (0, {}), 3: (None, {}), 4: (1, {"c": 1})}
