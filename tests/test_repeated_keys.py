"""Equal keys of attention count once with their number."""

import numpy as np
import pytest
from graphspan.operators import blocks


def test_equal_keys_meet_a_query_once(spark):
    rng = np.random.default_rng(1)
    kinds = [(rng.normal(size=2).tolist(), rng.normal(size=2).tolist()) for _ in range(3)]
    often = [400, 50, 7]
    asked = {i: rng.normal(size=2).tolist() for i in range(5)}
    queries = spark.createDataFrame(list(asked.items()), "id int, q array<double>")
    repeated = spark.createDataFrame([kv for kv, n in zip(kinds, often, strict=True) for _ in range(n)], "k array<double>, v array<double>")
    counted = spark.createDataFrame([(*kv, n) for kv, n in zip(kinds, often, strict=True)], "k array<double>, v array<double>, n long")

    def score(q, k):
        if len(k) > 4:
            raise ValueError("equal keys stand apart")
        return q @ k.T

    default = ([0.5, -0.5], [2.0, 3.0])
    k, v, n = np.array([x for x, _ in kinds] + [default[0]]), np.array([x for _, x in kinds] + [default[1]]), np.array([*often, 1])
    for keys, more in ((repeated, {}), (counted, {"times": "n"})):
        got = {r.id: r.out for r in blocks.attended_set(queries, "id", "q", keys, "k", "v", "out", default, score=score, **more).collect()}
        for i, q in asked.items():
            e = np.exp(k @ np.array(q)) * n
            assert got[i] == pytest.approx((e @ v / e.sum()).tolist())
