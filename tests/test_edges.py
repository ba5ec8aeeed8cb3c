"""Nulls, empty tables, repeated keys, large ids and failing encoders."""

import numpy as np
import pytest

from lexivane.operators import evaluation, knn, vocab
from lexivane.operators.encode import encode_columns, model_bytes
from lexivane.session import new_path
from lexivane.sources import tables, triplets


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_rows_may_repeat(spark, limit):
    model = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 2.0])], "token string, vector array<float>")
    rows = [(1, 0, "cat"), (1, 1, "dog"), (1, 1, "dog"), (None, 2, "cat dog")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, text string").repartition(3)
    got = encode_columns(df, {"v": ("text", model)}, model_limit=limit)
    assert got.columns == ["conv_id", "turn", "text", "v"]
    found = sorted((r["turn"], r["v"]) for r in got.collect())
    assert found == [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, [0.5, 1.0])]


def test_models_share_one_limit(spark):
    schema = "token string, vector array<float>"
    first = spark.createDataFrame([("cat", [1.0, 0.0])], schema)
    second = spark.createDataFrame([("cat", [0.0, 3.0])], schema)
    assert model_bytes(first)[0] == 48
    df = spark.createDataFrame([(0, "cat")], "idx bigint, text string")
    specs = {"a": ("text", first), "b": ("text", second)}
    for limit in (0, 50, 100):
        got = encode_columns(df, specs, model_limit=limit)
        assert got.columns == ["idx", "text", "a", "b"]
        assert [(r["a"], r["b"]) for r in got.collect()] == [([1.0, 0.0], [0.0, 3.0])]


def test_first_rows_after_a_filter(spark):
    rows = spark.range(20).withColumnRenamed("id", "idx").filter("idx % 3 = 0")
    assert sorted(r["idx"] for r in triplets.first_rows(rows, 4).collect()) == [0, 3, 6, 9]
    assert triplets.first_rows(rows, 100).count() == 7
    assert triplets.first_rows(rows, 0).count() == 0


def test_large_text_numbers(spark):
    rows = [(1 << 62, "b a"), ((1 << 62) - 1, "c"), (-5, "d")]
    texts = spark.createDataFrame(rows, "ord bigint, text string")
    for size in (10, 30_000):
        got = vocab.create_vocabulary(texts, size).orderBy("token_id").collect()
        assert [r["token"] for r in got] == ["d", "c", "b", "a"]


def test_missing_predictions_are_wrong(spark):
    df = spark.createDataFrame([(1, 1), (None, 1), (None, 0), (0, 0)], "prediction int, truth int")
    assert evaluation.classification_metrics(df, truth="truth").first()["accuracy"] == 0.5
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluation.confusion_matrix(df, truth="truth").collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    with pytest.raises(Exception, match="truth is null"):
        evaluation.classification_metrics(df.selectExpr("prediction", "int(null) AS truth"), truth="truth").collect()


def _vectors(spark, key, rows):
    return spark.createDataFrame(rows, f"{key} bigint, vector array<float>")


def test_nearest_of_nothing(spark):
    some = [(0, [1.0, 0.0]), (1, None), (2, [3.0, 0.0])]
    queries, docs = _vectors(spark, "query_idx", some), _vectors(spark, "corpus_idx", some)
    for search in (knn.nearest, knn.nearest_by_cells):
        assert search(queries.limit(0), docs).count() == 0
        assert search(queries, docs.limit(0)).count() == 0
    found = knn.nearest(queries, docs, 5).orderBy("query_idx", "rank").collect()
    assert [(r["query_idx"], r["corpus_idx"]) for r in found] == [(0, 0), (0, 2), (2, 2), (2, 0)]


def test_cells_always_give_k(spark):
    rng = np.random.default_rng(4)
    points = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    queries, docs = _vectors(spark, "query_idx", points[:20]), _vectors(spark, "corpus_idx", points)
    got = knn.nearest_by_cells(queries, docs, 25, cells=12, probes=1)
    assert {r["count"] for r in got.groupBy("query_idx").count().collect()} == {25}
    assert got.count() == 500


def test_failed_rows_are_kept_and_tried_again(spark):
    def factory(bad):
        def encode(items):
            if bad in items:
                raise ValueError("no")
            return [[float(len(x))] for x in items]

        return lambda: encode

    path = new_path(spark, "features")
    df = spark.createDataFrame([(i, "x" * i) for i in range(6)], "corpus_idx bigint, pair string")
    assert tables.encode_and_save(df, path, factory("xx")).count() == 5
    failed = tables.failed_rows(spark, path).collect()
    assert [(r["corpus_idx"], r["embedding_error"]) for r in failed] == [(2, "ValueError: no")]
    saved = tables.encode_and_save(df, path, factory("none"))
    assert {r["corpus_idx"]: r["embedding"] for r in saved.collect()} == {i: [float(i)] for i in range(6)}
    assert tables.failed_rows(spark, path).count() == 0
