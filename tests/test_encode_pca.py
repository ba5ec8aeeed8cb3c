import numpy as np
import pytest

from lexivane.operators import pca
from lexivane.operators.encode import encode_column, encode_columns, explode_tokens


@pytest.fixture
def model(spark):
    rows = [(0, "cat", [1.0, 0.0]), (1, "dog", [0.0, 2.0])]
    return spark.createDataFrame(rows, "token_id bigint, token string, vector array<float>")


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("normalize", [False, True])
def test_mean_of_known_tokens(spark, model, limit, normalize):
    rows = [(0, "Cat cat dog what"), (1, "nothing known"), (2, None), (3, "dog"), (4, "")]
    df = spark.createDataFrame(rows, "idx bigint, text string").repartition(2)
    got = encode_columns(df, {"v": ("text", model)}, normalize=normalize, model_limit=limit)
    by_id = {r["idx"]: r["v"] for r in got.collect()}
    mean = np.array([2 / 3, 2 / 3])
    assert by_id[0] == pytest.approx(list(mean / np.linalg.norm(mean)) if normalize else list(mean))
    assert by_id[3] == pytest.approx([0.0, 1.0] if normalize else [0.0, 2.0])
    assert by_id[1] == by_id[2] == by_id[4] == [0.0, 0.0]


def test_both_encoders_agree_on_several_columns(spark, model):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["cat", "dog", "x"], size=i % 9)), "dog " * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "idx bigint, a string, b string")
    specs = {"va": ("a", model), "vb": ("b", model)}
    small, large = (
        encode_columns(df, specs, model_limit=limit).orderBy("idx").select("va", "vb").collect() for limit in (1 << 20, 0)
    )
    for x, y in zip(small, large):
        assert x["va"] == pytest.approx(y["va"]) and x["vb"] == pytest.approx(y["vb"])


def test_batch_encoder_retries_row_by_row(spark):
    def factory():
        def encode(items):
            if "bad" in items:
                raise ValueError("cannot")
            return [[float(len(t))] for t in items]

        return encode

    df = spark.createDataFrame([("a",), ("bad",), ("ccc",)], "t string").coalesce(1)
    got = {r["t"]: (r["v"], r["v_error"]) for r in encode_column(df, "t", "v", factory, 3).collect()}
    assert got["a"] == ([1.0], None) and got["ccc"] == ([3.0], None)
    assert got["bad"][0] is None and "cannot" in got["bad"][1]


def test_batch_encoder_takes_pairs(spark):
    df = spark.createDataFrame([(("Find", "a"),)], "p struct<instruction: string, text: string>")
    got = encode_column(df, "p", "v", lambda: lambda items: [[len(i[0]), len(i[1])] for i in items]).first()
    assert got["v"] == [4.0, 1.0]


def test_explode_tokens(spark, model):
    df = spark.createDataFrame([(0, "dog none cat")], "idx bigint, t string")
    got = explode_tokens(df, ["idx"], "t", model).orderBy("position").collect()
    assert [(r["position"], r["token"], r["l2_norm"]) for r in got] == [(0, "dog", 2.0), (2, "cat", 1.0)]


def matrix(spark, n=100, width=10):
    rng = np.random.default_rng(79)
    data = rng.random((n, width))
    rows = [(i, row.tolist()) for i, row in enumerate(data)]
    return data, spark.createDataFrame(rows, "token_id bigint, vector array<double>").repartition(4)


def collected(df):
    return np.array([r["vector"] for r in df.orderBy("token_id").collect()])


def reference(fit, data, k):
    mean = fit.mean(axis=0)
    _, _, axes = np.linalg.svd(fit - mean, full_matrices=False)
    axes = axes[:k].T
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return (data - mean) @ (axes * signs)


def test_projection_is_centred_with_fixed_signs(spark):
    data, df = matrix(spark)
    assert collected(pca.reduce_dimensions(df, "vector", 3)) == pytest.approx(reference(data, data, 3))


def test_fit_on_seen_tokens_only(spark):
    data, df = matrix(spark)
    seen = [0, 3, 10, 11, 12, 50]
    counts = spark.createDataFrame([(i, 1) for i in seen] + [(5, 0)], "token_id bigint, n bigint")
    got = collected(pca.reduce_dimensions(df, "vector", 2, counts))
    assert got.shape == (100, 2) and got == pytest.approx(reference(data[seen], data, 2))


def test_special_widths(spark):
    data, df = matrix(spark)
    assert collected(pca.reduce_dimensions(df, "vector", None)) == pytest.approx(data)
    for dims in ("auto", 99):
        full = collected(pca.reduce_dimensions(df, "vector", dims))
        assert full == pytest.approx(reference(data, data, 10))
    few = df.filter("token_id < 8")
    assert collected(pca.reduce_dimensions(few, "vector", 8)) == pytest.approx(data[:8])
    none = spark.createDataFrame([(1, 0)], "token_id bigint, n bigint")
    assert collected(pca.reduce_dimensions(df, "vector", 2, none)) == pytest.approx(reference(data, data, 2))
    one = spark.createDataFrame([(1, 5)], "token_id bigint, n bigint")
    with pytest.raises(ValueError):
        pca.reduce_dimensions(df, "vector", 2, one)


def test_column_and_variance(spark):
    data, df = matrix(spark)
    assert collected(pca.reduce_column(df, 2, "vector")).shape == (100, 2)
    ratios = [r["ratio"] for r in pca.Projection(df, "vector", 10).variance_report(df).orderBy("component").collect()]
    assert ratios == sorted(ratios, reverse=True) and sum(ratios) == pytest.approx(1)
