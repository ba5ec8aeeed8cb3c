"""Whitening against exact sums and numpy's eigenvectors; the divide and conquer on matrices with known values."""

import math

import numpy as np
import pytest

from lexivane.llm import queries, spectral, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, n int, deviation string"


def _matrices():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    yield from (np.eye(5), np.zeros((4, 4)), np.diag([1.0, 1, 1, 2]), np.diag([5.0, 4, 3, 2, 1]), np.ones((7, 7)), np.array([[3.0]]))
    yield from (q @ np.diag([1.0] * k + [2.0] * (20 - k)) @ q.T for k in (1, 10, 18))
    for n, rows in ((2, 9), (64, 300), (40, 5)):
        x = rng.normal(size=(rows, n)) * np.logspace(0, -6, n)
        yield x.T @ x
    yield np.kron(np.eye(4), np.array([[2, 1], [1, 2.0]]))


@pytest.mark.parametrize("a", _matrices())
def test_eigen(a):
    values, vectors = spectral.eigen(a)
    scale = np.linalg.norm(a) or 1.0
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * scale)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * scale


def test_polar_factor():
    a = np.random.default_rng(1).normal(size=(12, 12))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert np.allclose(spectral.polar_factor(a), vectors @ np.diag(np.sign(values)) @ vectors.T, atol=1e-12)


def _rows():
    rng = np.random.default_rng(2)
    made = (rng.normal(size=(120, 6)) * [3, 1, 0.5, 0.5, 0.2, 0.1] + 1.3).astype(np.float32).tolist()
    rows = [(i, v, i % 3, "x", 5, "d") for i, v in enumerate(made)]
    rows += [(500 + i, made[7], None, None, None, None) for i in range(60)] + [rows[3], (None, made[9], 1, "x", 5, "d")]
    odd = [None, [], [1.0] * 5 + [None], [1.0] * 5 + [math.nan], [math.inf] + [1.0] * 5, [1.0] * 4, [1.0] * 7]
    return rows + [(900 + i, v, 1, "x", 5, "d") for i, v in enumerate(odd)]


def _check(got, rows, count):
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v, *_ in rows if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    fitted = sorted({tuple(x) for _, x in kept})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in fitted], float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == len(kept) * min(count, 6) and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
    flips = {}
    for vec, x in kept:
        offset = [n * c - s for c, s in zip(x, sums)]
        for c in range(1, min(count, 6) + 1):
            r = by[vec, c][0]
            assert int(r["deviation"]) == sum(o * o for o in offset)
            want = float(np.array(offset, float) / n @ axes[:, c - 1]) / math.sqrt(values[c - 1])
            sign = flips.setdefault(c, 1 if want * r["whitened"] >= 0 else -1)
            assert abs(sign * r["whitened"] - want) < 1e-9


@pytest.mark.parametrize("count", [2, 16])
def test_against_numpy(spark, count):
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(5)
    got = whitening.components(df, ["vec_id", "x"], count=count)
    assert got.columns == ["vec_id", "x", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    _check(got.collect(), _rows(), count)


def test_huge_entries_stay_exact(spark):
    rows = [(i, [float(2**40 * (i % 7)), float(i), 1e30 if i == 3 else -1.0], 1, "x", 1, "d") for i in range(30)]
    got = whitening.project(*[f(whitening.integer_rows(spark.createDataFrame(rows, SCHEMA), "embedding")) for f in (lambda r: r, whitening.fit)], ["vec_id"])
    x = [[max(-(2**52), min(2**52, math.floor(64 * c))) + 1_000_000 for c in np.float32(v).tolist()] for _, v, *_ in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((30 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in got.collect()} == want


def test_nothing_to_fit(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None, 1, "x", 1, "d")], [(1, [1.0, 2.0], 1, "x", 1, "d"), (2, [1.0, 2.0], 1, "x", 1, "d")]):
        got = whitening.components(spark.createDataFrame(rows, SCHEMA), ["vec_id"])
        assert got.columns == names and got.count() == 0


def test_registered(spark):
    got = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert got.count() == 500 * 16 and got.filter("identity_error > 1e-9 or deviation is null").count() == 0
