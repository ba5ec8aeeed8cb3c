"""Arrows and components from narrow rows: equal to those from every occurrence and every vector."""

import numpy as np
import pytest

from lexivane.operators import compare, pca
from lexivane.operators.encode import explode_tokens


@pytest.fixture(scope="module")
def talk(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]
    model = spark.createDataFrame([(w, [float(x) for x in rng.normal(size=6)]) for w in words], "token string, vector array<float>")
    texts = [(i, " ".join(["w0"] * (i % 3) + [words[j] for j in rng.integers(0, 40, i % 17)] + ["none"] * (i % 2))) for i in range(60)]
    texts.append((60, " ".join(words[j] for j in rng.integers(0, 40, 2500))))
    return spark.createDataFrame(texts + [(61, None), (62, "none")], "k int, t string").repartition(4), model


@pytest.mark.parametrize("send,block", [(1 << 20, 1024), (0, 7)])
def test_arrows_in_blocks(spark, talk, send, block):
    texts, model = talk
    shares = compare.contributions(explode_tokens(texts, ["k"], "t", model), ["k"])
    old = compare.token_arrows(shares.selectExpr("*", "share[0] as x", "share[1] as y"), ["k"])
    points = compare.text_points(texts, ["k"], "t", model, send_bytes=send)
    assert "vector" not in points.columns
    new = compare.chain_arrows(points, ["k"], block_tokens=block)
    assert new.columns == old.columns
    a, b = ({(r["k"], r["position"]): tuple(r)[3:] for r in df.collect()} for df in (old, new))
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-9) for i in a)


def test_plane_by_token_weight(spark, talk):
    texts, model = talk
    shares = compare.contributions(explode_tokens(texts, ["k"], "t", model), ["k"])
    whole = pca.Projection(shares, "share", 2)
    points = compare.text_points(texts, ["k"], "t", model)
    plane = compare.weighted_plane(model, compare.point_weights(points, ["k"]))
    assert np.allclose(whole.axes, plane.axes, atol=1e-9) and np.allclose(whole.offset, plane.offset, atol=1e-9)
    assert np.allclose(whole.explained, plane.explained, atol=1e-9)


@pytest.mark.parametrize("width,k,whole", [(60, 4, 10), (60, 60, 10), (30, 3, 256), (1, 1, 256)])
def test_axes_from_products(width, k, whole):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(200, width)) * np.linspace(2, 1, width)
    full = x.T @ x / 200
    rounds = []
    values, axes = pca.leading_axes(lambda block: rounds.append(1) or full @ block, width, k, whole)
    want, vectors = np.linalg.eigh(full)
    assert np.allclose(values, want[::-1][:k], rtol=1e-9)
    assert np.allclose(np.abs(np.einsum("ij,ij->j", axes, vectors[:, ::-1][:, :k])), 1, atol=1e-7)
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-10


def test_rank_below_the_block(spark):
    values, axes = pca.leading_axes(lambda block: np.diag([3.0, 2.0, *[0.0] * 28]) @ block, 30, 2, 4)
    assert np.allclose(values, [3, 2]) and np.allclose(np.abs(axes[[0, 1], [0, 1]]), 1)


def test_projection_keeps_other_columns_and_missing_vectors(spark):
    rows = [(i, [float(i), float(i * i % 7), 1.0], "f", "p") for i in range(12)] + [(12, None, "f", "p")]
    df = spark.createDataFrame(rows, "id int, vector array<float>, features string, projected string")
    plane = pca.Projection(df.filter("vector is not null"), "vector", 2)
    got = plane.apply(df, "vector")
    assert set(got.columns) == set(df.columns) and got.filter("features = 'f' and projected = 'p'").count() == 13
    assert got.filter("id = 12").first()["vector"] is None and len(got.filter("id = 3").first()["vector"]) == 2
    assert plane.apply(df, "vector", "flat").columns == [*df.columns, "flat"]
