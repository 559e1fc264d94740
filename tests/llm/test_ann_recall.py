"""Recall on vectors of low intrinsic dimension."""

import numpy as np

from parley.llm import ann


def test_recall_on_low_rank_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 8)) @ rng.normal(size=(8, 64))
    x = np.float32(x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert len(got) == 100 and hit >= 0.9 * 20 * 100
