"""Hard negatives against brute force: lengths that differ, ties, copies, nulls, several blocks and small buckets."""

import math

import numpy as np
import pytest

from lexivane.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, id string, anchor int"


def _rows(seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(260):
        v = centres[i % 6] + spread * rng.normal(size=8)
        v = v / np.linalg.norm(v) * (1 if seed == 1 else float(rng.choice([0.2, 1, 3])))
        rows.append((i, np.round(v, 1 if seed == 3 else 7).astype(np.float32).tolist(), int(rng.integers(0, 3)), "x", "y", 1))
    rows += [(1000 + i, rows[20][1], i % 2, None, None, None) for i in range(40)]
    rows += [(2000, [0.0] * 8, 1, "x", "y", 1), (2001, [-0.5] * 8, 77, "x", "y", 1), rows[20], rows[20], rows[5], (None, rows[20][1], 1, "x", "y", 1)]
    odd = [None, [], [1.0] * 7 + [None], [math.nan] + [1.0] * 7, [-math.inf] + [1.0] * 7, [1.0] * 9]
    return rows + [(3000 + 20 * i, v, 1, "x", "y", 1) for i, v in enumerate(odd)] + [(4000, [1.0] * 8, None, "x", "y", 1)]


def _expected(rows, step, k, m, low, high):
    none = 1 << 63
    kept = [
        (none if i is None else i, label, [math.floor(256 * float(c)) for c in v])
        for i, v, label, *_ in rows
        if label is not None and v and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = []
    for i, label, x in sorted({(i, label, tuple(x)) for i, label, x in kept if i != none and i % step == 0}):
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, other == label) for j, other, y in kept if j != i)
        for p, j, _ in [s for s in scored if s[2]][:k]:
            fits = [s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p][:m]
            out += [(i, None if j == none else j, r + 1, None if s[1] == none else s[1], -p, -s[0]) for r, s in enumerate(fits)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,spread,block,bucket", [(1, 0.2, 1 << 22, 2048), (2, 1.0, 8000, 16), (3, 0.6, 8000, 16), (4, 0.05, 1 << 22, 32)])
def test_against_brute_force(spark, seed, spread, block, bucket):
    rows = _rows(seed, spread)
    made = negatives.integer_rows(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = negatives.mine(made, made.filter("id % 20 = 0"), positives=3, negatives=4, low=70, high=90, bucket=bucket, block_bytes=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _expected(rows, 20, 3, 4, 70, 90)


def test_ranges_leave_rows_out(monkeypatch):
    """Close anchors demand a high cosine, so most rows of a bucket are never verified."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 8))
    x = np.round(3000 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int32)
    verified = []
    scores = negatives._Search.scores
    monkeypatch.setattr(negatives._Search, "scores", lambda self, a, x: verified.append(len(a) * len(x)) or scores(self, a, x))
    near = x[:10] * 2
    lo = (0.95 * np.einsum("ij,ij->i", near.astype(float), x[:10])).astype(np.int64)[:, None]
    block = negatives.Block(np.arange(10), np.arange(10) + 5000, np.zeros(10, np.int64), near, lo, np.full((10, 1), 1 << 60), True)
    found = negatives._Search(block, 3, negatives.FOCUS)
    order = np.argsort(negatives._unit(x, negatives._lengths(x)), axis=0, kind="stable").T.astype(np.uint16)
    found.bucket(float(negatives._lengths(x).max()), np.arange(2000), np.zeros(2000, np.int64), x, order)
    exact = near.astype(np.int64) @ x.T.astype(np.int64)
    want = {(a, i, exact[a, i]) for a in range(10) for i in sorted(range(2000), key=lambda i: (-exact[a, i], i))[:3] if exact[a, i] >= lo[a, 0]}
    assert {(h["anchor"], h["id"], h["score"]) for h in found.hits().to_pylist()} == want
    assert sum(verified) < 0.25 * exact.size


def test_large_entries_are_exact(spark):
    rows = [(i, [3e5 + i, 2e5 - 7 * i], i % 2, "x", "y", 1) for i in range(60)]
    made = negatives.integer_rows(spark.createDataFrame(rows, SCHEMA))
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v, *_ in rows}
    got = negatives.mine(made, made.filter("id % 20 = 0"), low=1, high=200).collect()
    assert got and all(r["negative_score"] == sum(a * b for a, b in zip(x[r["anchor_id"]], x[r["negative_id"]])) for r in got)


def test_nothing_to_ask(spark):
    for rows in ([], _rows(1, 0.5)[1:19], [(0, [1.0, 2.0], None, "x", "y", 1)]):
        made = negatives.integer_rows(spark.createDataFrame(rows, SCHEMA))
        assert negatives.mine(made, made.filter("id % 20 = 0")).count() == 0
    alone = negatives.integer_rows(spark.createDataFrame([(20, [1.0, 2.0], 1, "x", "y", 1)], SCHEMA))
    assert negatives.mine(alone, alone.filter("id % 20 = 0")).count() == 0
