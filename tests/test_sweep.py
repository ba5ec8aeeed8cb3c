"""The grid of a sweep against encoding every setting by itself."""

import numpy as np
import pytest

from lexivane.operators import sweep


@pytest.mark.parametrize("limit,cells", [(1 << 28, 4_000_000), (1500, 90)])
def test_grid(spark, monkeypatch, limit, cells):
    monkeypatch.setattr(sweep, "_CELLS", cells)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    table = rng.normal(size=(30, 12)).astype(np.float32)
    sifs = {0.5: rng.random(30), 0.1: rng.random(30)}
    texts = [[" ".join(["no", *(words[j] for j in rng.integers(0, 30, rng.integers(0, 9)))]) for _ in range(3)] for _ in range(40)]
    texts += [["", "w1", "w2"], ["w1", "w1", "w1"], [None, "w3", "w4 w4"]]
    pairs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "idx bigint, query string, positive string, negative string").repartition(3)
    model = spark.createDataFrame([(i, w, table[i].tolist()) for i, w in enumerate(words)], "token_id bigint, token string, vector array<float>")
    weights = spark.createDataFrame([(s, i, float(w)) for s, ws in sifs.items() for i, w in enumerate(ws)], "sif double, token_id bigint, weight double")
    got = sweep.sweep(pairs, model, weights, [12, 3, 5], [30, 10], [False, True], model_limit=limit).collect()
    assert len(got) == len(texts) * 2 * 3 * 2 * 2

    def mean(t, sif, size, dim, unit):
        known = [words.index(w) for w in (t or "").split() if w in words[:size]]
        v = np.mean([table[i, :dim].astype(float) * sifs[sif][i] for i in known], axis=0) if known else np.zeros(dim)
        return v / (np.linalg.norm(v) + 1e-12) if unit else v

    for r in got:
        q, p, n = (mean(t, r["sif"], r["vocab_size"], r["output_dim"], r["normalize"]) for t in texts[r["idx"]])
        assert r["prediction"] == int(round(np.linalg.norm(q - p), 6) < round(np.linalg.norm(q - n), 6))
    with pytest.raises(ValueError):
        sweep.sweep(pairs, model, weights, [13], [30])
