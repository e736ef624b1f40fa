"""Neighbours by inner product are found whatever the lengths of the vectors."""

import numpy as np
import pytest
from riskmill.llm import ann

N, WIDTH, K = 12000, 32, 20


@pytest.mark.parametrize("kind", ["unit", "one long", "log-normal"])
def test_recall_does_not_hang_on_the_norms(spark, kind):
    rng = np.random.default_rng(21)
    x = rng.standard_normal((N, WIDTH))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "one long":
        x[17] *= 20
    if kind == "log-normal":
        x *= np.exp(0.5 * rng.standard_normal((N, 1)))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, v array<double>")
    found: dict = {}
    for r in ann.nearest(frame, frame.where("id % 200 = 0"), K).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(found) == N // 200
    hits = 0
    for q, got in found.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got & set(np.argsort(-score)[:K].tolist()))
    print(kind, hits / K / len(found))
    assert hits >= 0.97 * K * len(found), hits / K / len(found)
