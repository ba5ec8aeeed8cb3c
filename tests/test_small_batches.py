"""Python workers get and hold few texts at a time, however large a partition is."""

import numpy as np
import pyarrow as pa

from lexivane.operators import bm25, cells, encode

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_texts_are_sent_and_held_in_small_batches(spark, monkeypatch):
    spark.conf.set(KEY, "10000")
    rows = spark.range(3000).coalesce(1).selectExpr("id as idx", "concat('a b c', id % 7) as query", "'a b' as positive", "'b' as negative")
    model = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "token string, vector array<double>")
    most = spark.sparkContext.accumulator(0)
    row_terms, sum_vectors = bm25._row_terms, encode._sum_vectors

    def counted_terms(batch):
        most.add(batch.num_rows > 250)
        return row_terms(batch)

    def counted_sums(lists, tokens, table):
        most.add(len(lists) > 250)
        return sum_vectors(lists, tokens, table)

    monkeypatch.setattr(bm25, "_row_terms", counted_terms)
    monkeypatch.setattr(encode, "_sum_vectors", counted_sums)
    got = bm25.predict_pairs(rows)
    assert int(spark.conf.get(KEY)) <= 1000
    assert got.filter("prediction = 1").count() + got.filter("prediction = 0").count() == 3000
    coded = encode.encode_columns(rows, {"vector": ("query", model)})
    assert {tuple(r[0]) for r in coded.select("vector").distinct().collect()} == {(0.5, 1.0)}
    assert most.value == 0


def test_pivot_distances_are_computed_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    held = cells.Cells(None, rng.normal(size=(12, 3)), rng.integers(0, 9, 12))
    asked = rng.normal(size=(50, 3))
    table = pa.table({"query_idx": pa.array(range(50), pa.int64()), "vector": pa.array(asked.tolist())})
    _, whole = cells._prepare(held, 5, 2)(table)
    monkeypatch.setattr(cells, "_FAR", 40)
    sizes, distances = [], cells._distances
    monkeypatch.setattr(cells, "_distances", lambda v, p: sizes.append(len(v) * len(p)) or distances(v, p))
    _, parts = cells._prepare(held, 5, 2)(table)
    assert max(sizes) <= 40 and (whole.probed == parts.probed).all() and np.allclose(whole.far, parts.far)
