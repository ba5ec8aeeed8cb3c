"""Encoding that is cut short and taken up again, one encoder a worker, and models that are sent in parts."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.operators import encode
from lexivane.sources import tables


def letters(log, stop=None):
    """Encodes a text as its length and logs every text; stops at one of them while the file `stop` is there."""

    def factory():
        def code(items):
            with open(log, "a") as out:
                out.writelines(f"{x}\n" for x in items)
            if stop and os.path.exists(stop) and "t40" in items:
                os._exit(1)
            return [[float(len(x))] for x in items]

        return code

    return factory


def test_only_uncommitted_rows_are_encoded_again(spark, tmp_path):
    path, log, stop = (str(tmp_path / x) for x in ("features", "log", "stop"))
    df = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "corpus_idx bigint, pair string").coalesce(1)
    open(stop, "w").close()
    options = {"chunk_size": 10, "files_per_commit": 1, "batch_size": 5}
    with pytest.raises(Exception):
        tables.encode_and_save(df, path, letters(log, stop), **options)
    committed = {r["pair"] for r in spark.read.parquet(path).collect()}
    assert 0 < len(committed) < 60 and "t40" not in committed
    before = Counter(open(log).read().split())
    os.rename(stop, stop + "-gone")
    saved = tables.encode_and_save(df, path, letters(log, stop), **options)
    assert {r["corpus_idx"]: r["embedding"] for r in saved.collect()} == {i: [float(len(f"t{i}"))] for i in range(60)}
    again = Counter(open(log).read().split()) - before
    assert set(again) == {f"t{i}" for i in range(60)} - committed
    more = spark.createDataFrame([(i, f"t{i}") for i in range(55, 70)], "corpus_idx bigint, pair string")
    before = Counter(open(log).read().split())
    assert tables.encode_and_save(more, path, letters(log, stop), **options).count() == 70
    assert Counter(open(log).read().split()) - before == Counter(f"t{i}" for i in range(60, 70))


def test_one_encoder_a_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def factory():
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        return lambda items: [[float(len(x)), 1.0] for x in items]

    df = spark.range(200).select(F.col("id"), F.lit("abc").alias("t")).repartition(40)
    coded = encode.encode_column(df, "t", "v", factory, encoder_key="letters")
    assert coded.filter("v[0] = 3").count() == 200 and coded.count() == 200
    loads = Counter(open(log).read().split())
    assert max(loads.values()) == 1 and len(loads) < 40


def test_ragged_and_missing_vectors(spark):
    factory = lambda: lambda items: [[1.0] * len(x) for x in items]
    df = spark.createDataFrame([("",), ("ab",), (None,), ("abc",)], "t string").coalesce(1)
    got = encode.encode_column(df, "t", "v", factory, 10).collect()
    assert [r["v"] for r in got] == [[], [1.0, 1.0], None, [1.0, 1.0, 1.0]]
    assert [r["v_error"] is None for r in got] == [True, True, False, True]


@pytest.mark.parametrize("normalize", [False, True])
def test_a_model_in_parts_under_a_hot_token(spark, monkeypatch, normalize):
    monkeypatch.setattr(encode, "_LEAST_PART", 3000)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    model = spark.createDataFrame([(w, [float(x) for x in rng.normal(size=5)]) for w in words], "token string, vector array<float>")
    texts = [" ".join(["w0"] * (i % 10 != 0) + [words[j] for j in rng.integers(0, 120, i % 9)] + ["unseen"]) for i in range(200)]
    rows = [(i, t, "s", 1, "x") for i, t in enumerate(texts)] + [(200, None, "s", 1, "x"), (3, texts[3], "s", 1, "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, _sum string, _known int, _tokens string").repartition(4)
    one, parts = (
        {(r["id"], r["text"]): r["v"] for r in encode.encode_columns(df, {"v": ("text", model)}, normalize, model_limit=limit).collect()}
        for limit in (1 << 30, 0)
    )
    assert encode.model_bytes(model)[0] > 2 * 3000 and one.keys() == parts.keys()
    assert all(np.allclose(one[k], parts[k], atol=1e-12) for k in one)
