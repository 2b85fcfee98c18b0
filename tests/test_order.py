"""Numbers and folds along an order, cut into several ranges, against plain loops."""

import random

import numpy as np
from graphspan.operators import layers, order
from pyspark.sql import functions as F


def events(spark, n=400):
    rng = random.Random(2)
    rows = [(rng.choice("aaaaabc"), i, rng.uniform(-1, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, i int, g double").repartition(5)


def test_numbers_and_running_sums(spark):
    rows, df = events(spark)
    got = order.running(df, [F.desc("k"), F.asc("i")], {"before": F.col("i"), "place": F.lit(1)}).collect()
    total = 0
    for place, r in enumerate(sorted(got, key=lambda r: (-ord(r["k"]), r["i"]))):
        assert (r["before"], r["place"]) == (total, place)
        total += r["i"]
    assert sorted(r["n"] for r in order.numbered(df, ["k", "i"], "n", 7).collect()) == list(range(7, 407))
    assert order.numbered(df.where("false"), ["k"], "n").count() == 0


def test_folds_go_over_the_ends_of_ranges(spark):
    rows, df = events(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the ranges apart
    try:
        pieces = order.in_ranges(df, "k", "i")
        assert pieces.select("_piece").distinct().count() > 1
        moved = {r["k"]: r["moved"] for r in order.adam_moves(pieces, "k", "g", "string", 0.1).collect()}
        mean = {r["k"]: (r["n"], r["state"]) for r in order.affine_fold(pieces, "k", "g", lambda t, x: (1 - 1 / np.minimum(np.arange(t + 1, t + 1 + len(x)), 10), x / np.minimum(np.arange(t + 1, t + 1 + len(x)), 10)), "string").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for k in "abc":
        m = v = x = average = 0.0
        for t, g in enumerate([g for kk, _, g in sorted(rows) if kk == k], 1):
            m, v = m * 0.9 + g * 0.1, v * 0.999 + g * g * 0.001
            x -= 0.1 * (m / (1 - 0.9**t)) / ((v / (1 - 0.999**t)) ** 0.5 + 1e-8)
            average = average * (1 - 1 / min(t, 10)) + g / min(t, 10)
        assert abs(moved[k] - x) < 1e-9 and mean[k][0] == t and abs(mean[k][1] - average) < 1e-9


def test_cells_against_plain_loops(spark):
    rng = np.random.default_rng(1)
    seqs = {k: rng.normal(size=(n, 3)) for k, n in (("a", 7), ("b", 1), ("c", 30))}
    df = spark.createDataFrame([(k, i, x.tolist()) for k, s in seqs.items() for i, x in enumerate(s)], "k string, i int, x array<double>").repartition(4)
    sig = lambda x: 1 / (1 + np.exp(-x))
    for kind in ("gru", "lstm"):
        cell = layers.seeded_cell(kind, "cell", 3, 2)
        w = cell.w
        got = {r["k"]: r["state"] for r in layers.recurrent(df, "k", "i", "x", cell).collect()}
        both = {(r["k"], r["i"]): r["state"] for r in layers.bidirectional(df, "k", "i", "x", cell, cell).collect()}
        for k, s in seqs.items():
            h, c = np.zeros(2), np.zeros(2)
            for x in s:
                if kind == "gru":
                    z, r = sig(w["wz"] @ x + w["uz"] @ h), sig(w["wr"] @ x + w["ur"] @ h)
                    h = (1 - z) * h + z * np.tanh(w["wh"] @ x + r * (w["uh"] @ h))
                else:
                    i, f, o = (sig(w["w" + g] @ x + w["u" + g] @ h + (g == "f")) for g in "ifo")
                    c = f * c + i * np.tanh(w["wg"] @ x + w["ug"] @ h)
                    h = o * np.tanh(c)
            assert np.allclose(got[k], h) and np.allclose(both[k, len(s) - 1][:2], h)
            first = np.asarray(cell.output(cell.step(cell.start(), s[-1])))
            assert np.allclose(both[k, len(s) - 1][2:], first)


def test_heads_of_attention(spark):
    rng = np.random.default_rng(2)
    q, xs = rng.normal(size=4), rng.normal(size=(5, 4))
    heads = [rng.normal(size=(2, 4)).tolist() for _ in range(3)]
    df = spark.createDataFrame([("n", q.tolist(), x.tolist()) for x in xs], "dst string, q array<double>, x array<double>")
    got = layers.multi_head_attention(df, "dst", "q", "x", heads).first()["vec"]
    want = []
    for m in map(np.array, heads):
        s = (xs @ m.T) @ (m @ q)
        s = np.where(s > 0, s, s * 0.2)
        a = np.exp(s - s.max())
        want += ((a / a.sum())[:, None] * (xs @ m.T)).sum(axis=0).tolist()
    assert np.allclose(got, want)
