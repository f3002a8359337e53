"""Recall of the nearest neighbours against all inner products, over several shards and norms."""

import numpy as np
import pytest

from strandloom.llm import ann


@pytest.mark.parametrize("norms", ["unit", "gaussian", "lognormal 0.1", "lognormal 0.5"])
def test_recall(spark, monkeypatch, norms):
    monkeypatch.setattr(ann, "LEAST_SHARD", 1500)
    monkeypatch.setattr(ann, "SHARD_ROOT", 0)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 48))
    if norms != "gaussian":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if norms.startswith("lognormal"):
        x *= np.exp(rng.normal(size=(4000, 1)) * float(norms.split()[1]))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.nearest(df).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    y, hits = x.astype(np.float64), 0
    assert sorted(found) == list(range(0, 4000, 20))
    for q, got in found.items():
        s = y @ y[q]
        best = [k for k in np.argsort(-s) if k != q][:20]
        hits += len(set(best) & set(got))
        assert all(abs(score - s[k]) < 1e-9 for k, score in got.items())
    assert hits / (20 * len(found)) >= 0.9
