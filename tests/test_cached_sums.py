"""Token vectors are gathered in parts that stay in a core's cache, with the same sums."""

import numpy as np
import pyarrow as pa

from lexivane.operators import encode


def test_parts_are_small_and_sums_whole(monkeypatch):
    rng = np.random.default_rng(3)
    tokens, table = pa.array([f"t{i}" for i in range(900)]), rng.normal(size=(900, 64)).astype(np.float32)
    texts = [rng.integers(0, 950, rng.integers(0, 400)) for _ in range(60)] + [rng.integers(0, 900, 20_000)]
    gathered, where = [], np.add.reduceat
    monkeypatch.setattr(encode.np, "add", type("Add", (), {"reduceat": staticmethod(lambda a, *r, **k: (gathered.append(a.nbytes), where(a, *r, **k))[1])}))
    sums, known = encode._sum_vectors(pa.array([[f"t{i}" for i in t] for t in texts]), tokens, table)
    assert len(gathered) > 1 and max(gathered) <= 1 << 20
    for text, total, n in zip(texts, sums, known):
        held = text[text < 900]
        assert n == len(held) and np.allclose(total, table[held].astype(float).sum(axis=0), rtol=1e-12, atol=1e-9)
