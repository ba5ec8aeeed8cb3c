"""BM25 over postings: equal to brute force, with blocks left unopened."""

import numpy as np
import pytest

from lexivane.operators import bm25, postings
from test_retrieval import brute_bm25, collection, lists, tokens  # noqa: F401


@pytest.mark.parametrize("query_bytes,block,expand", [(1 << 20, 512, 1_000_000), (400, 64, 50)])
def test_equal_to_brute_force(spark, collection, monkeypatch, query_bytes, block, expand):  # noqa: F811
    monkeypatch.setattr(postings, "_EXPAND", expand)
    queries, docs = collection
    made = postings.build(tokens(spark, docs, "corpus_idx"), block_docs=block)
    assert made.n_docs == len(docs)
    for k in (3, 8):
        got = postings.search(tokens(spark, queries, "query_idx"), made, k, query_bytes, tile_blocks=1)
        assert lists(got) == brute_bm25(queries, docs, k)


def test_most_blocks_stay_closed(spark):
    rng = np.random.default_rng(4)
    docs = [" ".join(["the", "of", *(f"topic{i // 100}w{j}" for j in rng.integers(0, 30, 12))]) for i in range(3000)]
    queries = [f"the of topic{t}w{a} topic{t}w{b}" for t, a, b in rng.integers(0, 30, (20, 3))] + ["the", "unseen"]
    made = postings.build(tokens(spark, docs, "corpus_idx").coalesce(2), block_docs=64)
    opened, met = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = postings.search(tokens(spark, queries[:20], "query_idx"), made, 5, opened=opened, met=met)
    assert lists(got) == brute_bm25(queries[:20], docs, 5)
    assert 0 < opened.value < 0.3 * met.value
    assert lists(postings.search(tokens(spark, queries, "query_idx"), made, 5)) == brute_bm25(queries, docs, 5)


def test_saved_and_empty(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["b"])], "corpus_idx bigint, tokens array<string>")
    postings.build(rows, str(tmp_path / "p"))
    made = postings.load(spark, str(tmp_path / "p"))
    assert made.n_docs == 4 and {tuple(r) for r in made.frequency.collect()} == {("a", 1), ("b", 2)}
    asked = rows.withColumnRenamed("corpus_idx", "query_idx")
    assert {q: [d for d, _ in found] for q, found in lists(postings.search(asked, made)).items()} == {1: [1, 4], 4: [4, 1]}
    none = postings.build(rows.limit(0))
    assert postings.search(asked, none).count() == 0 and postings.search(asked.limit(0), made).count() == 0


def test_pair_scores_where_the_rows_are(spark, capsys):
    words = np.array([f"w{i}" for i in range(15)])
    rng = np.random.default_rng(9)
    texts = lambda: " ".join(rng.choice(words, rng.integers(0, 12)))
    rows = [(i, texts(), texts(), texts()) for i in range(60)] + [(60, "w1", None, "w1"), (61, None, "w1", "w2"), (62, "w1", "", "")]
    df = spark.createDataFrame(rows, "idx bigint, query string, positive string, negative string").repartition(3)
    docs = tokens(spark, [texts() for _ in range(40)], "corpus_idx")
    sent, joined = (sorted(map(tuple, bm25.predict_pairs_global(df, docs, send_bytes=b).collect())) for b in (1 << 20, 0))
    assert len(sent) == 63 and [r[0::3] for r in sent] == [r[0::3] for r in joined]
    assert np.allclose([r[1:3] for r in sent if r[1] is not None], [r[1:3] for r in joined if r[1] is not None], atol=2e-6)
    bm25.predict_pairs(df).explain()
    assert "Exchange" not in capsys.readouterr().out.replace("Exchange RoundRobin", "").replace("Exchange round", "")
