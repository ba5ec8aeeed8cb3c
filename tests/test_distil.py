import numpy as np
import pytest

from lexivane.operators.distil import distil, token_table


@pytest.fixture
def factory():
    def make():
        return lambda items: [[float(len("".join(t))), 1.0, float("nan") if "bad" in t else 2.0] for t in items]

    return make


def frame(spark, tokens):
    return spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "token_id bigint, token string")


def texts(spark):
    return spark.createDataFrame([(0, "aa b aa zz"), (1, "b bad aa")], "ord bigint, text string")


def test_tokens_keep_internal_first_and_drop_matches(spark):
    external = frame(spark, ["b", "aa", "b", "Up"])
    internal = frame(spark, ["x", "[unused1]", "aa"])
    got = token_table(external, internal, r"\[unused\d+\]|\b\w*[A-Z]\w*\b").orderBy("token_id").collect()
    assert [tuple(r) for r in got] == [(0, "x", True), (1, "aa", True), (2, "b", False)]


def test_weighted_model(spark, factory):
    vocabulary = frame(spark, ["aa", "b", "bad", "none"])
    model, settings = distil(texts(spark), factory, vocabulary, pca_dims=None)
    got = {r["token"]: r for r in model.collect()}
    counts, total = {"aa": 3, "b": 2, "bad": 1, "none": 1, "[UNK]": 1}, 7
    for token, n in counts.items():
        weight = 1e-3 / (1e-3 + n / total)
        assert got[token]["weight"] == pytest.approx(weight)
        plain = np.array([len(token), 1.0, 0.0 if token == "bad" else 2.0])
        assert got[token]["vector"] == pytest.approx(list(plain * weight), rel=1e-6)
    assert settings["hidden_dim"] == 3 and settings["sif_coefficient"] == 1e-3


def test_switches(spark, factory):
    vocabulary = frame(spark, ["aa", "b", "bad", "none"])
    model, settings = distil(
        texts(spark), factory, vocabulary, instruction="Say", pca_dims=2, focus_pca=True,
        apply_zipf=False, prenormalize=True, pre_pca_normalize=True,
    )
    rows = model.collect()
    assert settings["sif_coefficient"] is None and {r["weight"] for r in rows} == {1.0}
    assert all(np.linalg.norm(r["vector"]) == pytest.approx(1.0, abs=1e-5) for r in rows)


def test_nothing_left_is_an_error(spark, factory):
    with pytest.raises(ValueError):
        distil(texts(spark), factory, frame(spark, ["a"]), token_remove_pattern="a")
    with pytest.raises(ValueError):
        distil(texts(spark), factory)
