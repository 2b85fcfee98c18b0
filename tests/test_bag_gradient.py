"""Gradients of bags need one number for each row of the table."""

import numpy as np
import pytest
from graphspan.operators import gradients


def test_entries_meet_one_number_for_each_row(spark, monkeypatch):
    monkeypatch.setattr(gradients, "mean_of_rows", lambda *_: pytest.fail("entries met every cell of a row"))
    table = np.array([[0.1, -0.2], [0.4, 0.3], [-0.5, 0.7]])
    w = np.array([0.6, -0.9])
    cells = [("e", i, j, float(table[i, j])) for i in range(3) for j in range(2)] + [("w", 0, j, float(w[j])) for j in range(2)]
    params = spark.createDataFrame(cells, gradients.SCHEMA)
    x = np.array([[2.0, 1, 0], [0, 0, 3], [1, 1, 1], [5, 0, 1]])
    y = np.array([1.0, 0, 1, 0])
    entries = [(d, i, float(x[d, i])) for d in range(4) for i in range(3) if x[d, i]] + [(9, 77, 1.0)]  # 77: a row that the table lacks
    df = spark.createDataFrame(entries, "d int, r long, x double")
    truth = spark.createDataFrame([*[(d, float(t)) for d, t in enumerate(y)], (9, 1.0)], "d int, y double")
    found, losses = gradients.logistic_bag_gradient(df, "d", "r", "x", truth, params, "e", "w")
    share = x / x.sum(1, keepdims=True)
    p = 1 / (1 + np.exp(-(share @ table @ w)))
    e = (p - y) / 4
    got = {(r.param, r.row, r.col): r.value for r in found.collect()}
    want = {("e", i, j): (share.T @ e)[i] * w[j] for i in range(3) for j in range(2)} | {("w", 0, j): (e @ share @ table)[j] for j in range(2)}
    assert got == pytest.approx(want)
    assert {r.d: r.p for r in losses.collect()} == pytest.approx(dict(enumerate(p)))
