"""Encoders of types and labels, layers and attention in blocks, sparse gradients, against plain versions."""

import math
import random

import numpy as np
import pytest
from graphspan.functions.vectors import seeded_vector
from graphspan.operators import blocks, encoders, gradients, layers
from graphspan.operators.blocks import Layer
from pyspark.sql import functions as F

SIZE = 3


def plain(layer, *parts):
    return layer(np.concatenate(parts)[None, :])[0]


def make(path, inputs, activation="relu"):
    return Layer(layers.seeded_weights(path, SIZE, inputs), [0.1] * SIZE, activation)


def test_types_of_any_depth(spark):
    """A chain of 40 types, each in the next one twice, and a leaf in all of them."""
    rng = random.Random(1)
    function, record, empty = make("f", 2 * SIZE), make("o", 2 * SIZE), [0.5, 0.25, -1.0]
    leaf = {k: np.array([rng.uniform(-1, 1) for _ in range(SIZE)]) for k in ("any", "number", "unknown")}
    label = {k: np.array([rng.uniform(-1, 1) for _ in range(SIZE)]) for k in ("a", "b", "c")}
    types, children = [(k, "any" if k == "any" else "var", k) for k in leaf] + [("{}", "object", None)], []
    for i in range(40):
        below = f"t{i - 1}" if i else "{}"
        types.append((f"t{i}", "func" if i % 2 else "object", None))
        if i % 2:
            children += [(f"t{i}", 0, None, below), (f"t{i}", 1, None, "any"), (f"t{i}", -1, None, below)]
        else:
            children += [(f"t{i}", 0, "a", below), (f"t{i}", 1, "b", below), (f"t{i}", 2, "c", "number")]
    types += [("open", "func", None), ("above", "object", None)]
    children += [("open", -1, None, "unknown"), ("above", 0, "a", "open")]
    position = lambda p: np.array([math.sin(p / 10_000 ** ((i - i % 2) / SIZE)) if i % 2 == 0 else math.cos(p / 10_000 ** ((i - i % 2) / SIZE)) for i in range(SIZE)])
    want = {"{}": np.array(empty)} | {k: v for k, v in leaf.items() if k != "unknown"}
    for name, kind, _ in types:
        parts = [c for c in children if c[0] == name]
        if parts and all(c[3] in want for c in parts):
            want[name] = sum(plain(function, want[c[3]], position(c[1])) if kind == "func" else plain(record, label[c[2]], want[c[3]]) for c in parts)
    got = encoders.encode_types(
        spark.createDataFrame(types, "type_id string, kind string, name string"), spark.createDataFrame(children, "type_id string, pos int, label string, child string"),
        spark.createDataFrame([(k, v.tolist()) for k, v in leaf.items() if k != "unknown"], "type_id string, vec array<double>"), spark.createDataFrame([(k, v.tolist()) for k, v in label.items()], "label string, vec array<double>"), function, record, empty,
    )
    got = {r.type_id: np.array(r.vec) for r in got.collect()}
    assert got.keys() == want.keys() and "open" not in got and "above" not in got
    for k, v in want.items():
        assert np.allclose(got[k], v, rtol=1e-9), k


@pytest.mark.parametrize("hot", [5, 10**6])
def test_labels_with_a_segment_in_half_of_all_names(spark, hot):
    names = ([f"get_thing{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + [f"other{i}Name" for i in range(200)]) * 2 + ["", "123", None, "get", "XMLToken"]
    uses = spark.createDataFrame([(n,) for n in names], "name string")
    vocabulary = spark.createDataFrame([("get",), ("other",), ("name",)], "segment string")
    layer = make("n", SIZE)
    got = {r.label: np.array(r.vec) for r in encoders.encode_labels(uses, "name", vocabulary, layer, SIZE, hot=hot).collect()}
    assert len(got) == len(set(names) - {None}) and not got[""].any() and not got["123"].any()
    one = {r.segment: np.array(r.vec) for r in encoders.segment_vectors(spark.createDataFrame([("get",), ("thingab",), ("other",), ("name",)], "segment string"), vocabulary, SIZE).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in one.values())
    assert np.allclose(got["get"], plain(layer, one["get"])) and np.allclose(got["get_thingab"], plain(layer, one["get"]) + plain(layer, one["thingab"]))
    assert np.allclose(got["other7Name"], plain(layer, one["other"]) + plain(layer, one["name"])) and np.allclose(got["other7Name"], got["other9Name"])


def test_dropout_leaves_common_segments(spark):
    uses = spark.createDataFrame([("often",), ("seldom",)], "name string")
    vocabulary = spark.createDataFrame([("often",), ("seldom",)], "segment string")
    encode = lambda **how: {r.label: r.vec for r in encoders.encode_labels(uses, "name", vocabulary, make("n", SIZE), SIZE, **how).collect()}
    whole = encode()
    dropped = encode(dropout=1.0, common=spark.createDataFrame([("often",)], "segment string"))
    assert dropped["often"] == whole["often"] and dropped["seldom"] != whole["seldom"]


def test_sparse_by_dense(spark):
    rng = random.Random(3)
    entries = [(i % 37, rng.choice(["hot", "hot", "a", "b", "none"]), rng.choice([1.0, 2.0, -0.5])) for i in range(500)]
    rows = {"hot": [1.0, 2.0], "a": [0.5, -1.0], "b": [3.0, 0.0]}
    want = {}
    for k, c, x in entries:
        if c in rows:
            want[k] = want.get(k, 0) + x * np.array(rows[c])
    for hot in (3, 10**6):
        got = encoders.sparse_dense_sums(spark.createDataFrame(entries, "k int, c string, x double"), "k", "c", "x", spark.createDataFrame(list(rows.items()), "d string, v array<double>"), "d", "v", 2, "out", hot, 5)
        got = {r.k: r.out for r in got.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], v) for k, v in want.items())


def message_rows(n=3000, seed=4):
    rng = random.Random(seed)
    vec = lambda: [rng.uniform(-2, 2) for _ in range(SIZE)]
    own = {k: vec() for k in range(40)}
    return [(k := rng.choice([0, 0, 0, *range(40)]), rng.choice("xyz"), own[k], vec()) for _ in range(n)]


def test_layers_in_blocks(spark):
    rows = message_rows()
    made = {k: make(f"kind{k}", 2 * SIZE, a) for k, a in zip("xyz", ("relu", "tanh", "none"), strict=True)}
    df = spark.createDataFrame(rows, "dst int, kind string, own array<double>, other array<double>").repartition(3)
    want = {}
    for k, kind, a, b in rows:
        want.setdefault(k, []).append(plain(made[kind], a, b))
    got = {r.dst: r for r in blocks.summed_layers(df, "dst", "kind", ["own", "other"], made, "vec", mean=True).collect()}
    assert got.keys() == want.keys()
    assert all(got[k].n == len(v) and np.allclose(got[k].vec, np.mean(v, axis=0)) for k, v in want.items())
    each = blocks.apply_layers(df, "kind", ["own", "other"], made, "y").collect()
    assert len(each) == len(rows) and all(np.allclose(r.y, plain(made[r.kind], r.own, r.other)) for r in each)
    assert blocks.summed_layers(df.limit(0), "dst", "kind", ["own", "other"], made, "vec").count() == 0
    x = np.array([r[3] for r in rows])
    dots = {(r.i, r.j): r.dot for r in blocks.gram(df, "other").collect()}
    assert all(abs(dots[i, j] - (x.T @ x)[i, j]) < 1e-6 for i in range(SIZE) for j in range(SIZE)) and len(dots) == SIZE * SIZE


def softmax_sum(scores, values):
    w = np.exp(scores - scores.max())
    return (w[:, None] * values).sum(0) / w.sum()


def test_attention_by_parts(spark):
    """Scores in the hundreds, so that parts have to be scaled to the largest."""
    rows = message_rows(seed=5)
    heads = [tuple(Layer((np.array(layers.seeded_weights(f"{h}{x}", 2, SIZE)) * 20).tolist(), None, "none") for x in "okv") for h in range(2)]
    df = spark.createDataFrame(rows, "dst int, kind string, own array<double>, other array<double>").repartition(5)
    got = {r.dst: r.vec for r in blocks.attended_messages(df, "dst", "own", "other", heads, "vec").collect()}
    for k in {r[0] for r in rows}:
        x, q = np.array([r[3] for r in rows if r[0] == k]), np.array([r[2] for r in rows if r[0] == k][:1])
        want = np.concatenate([softmax_sum(blocks.leaky((own(q) * other(x)).sum(1), 0.2), value(x)) for own, other, value in heads])
        assert np.allclose(got[k], want, rtol=1e-8), k
    one = {r.dst: r.vec for r in blocks.attended_messages(df, "dst", "own", "other", heads[:1], "vec").collect()}
    assert all(np.allclose(one[k], v[:2]) for k, v in got.items())


def test_attention_over_a_set_in_blocks(spark):
    rng = np.random.default_rng(6)
    q, k, v = rng.normal(size=(70, SIZE)) * 9, rng.normal(size=(90, SIZE)) * 9, rng.normal(size=(90, 2))
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "id int, q array<double>").repartition(3)
    keys = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(k, v, strict=True)], "k array<double>, v array<double>").repartition(4)
    default = ([1.0, 0.0, 0.0], [5.0, -5.0])
    for own, block in ((None, 7), (default, 7), (default, 1000)):
        allk, allv = (k, v) if own is None else (np.vstack([k, own[0]]), np.vstack([v, own[1]]))
        got = {r.id: r.out for r in blocks.attended_set(queries, "id", "q", keys, "k", "v", "out", own, block=block).collect()}
        assert len(got) == 70 and all(np.allclose(got[i], softmax_sum(q[i] @ allk.T, allv), rtol=1e-8) for i in range(70))
    alone = {r.id: r.out for r in blocks.attended_set(queries, "id", "q", keys.limit(0), "k", "v", "out", default).collect()}
    assert all(np.allclose(x, default[1]) for x in alone.values()) and len(alone) == 70


def test_attention_by_name(spark):
    rng = random.Random(7)
    names = ["_".join(rng.choice(["red", "big", "old", "ring", "cup"]) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    vecs = np.array([[rng.uniform(-1, 1) for _ in range(SIZE)] for _ in names])
    asked = [(1, "red_ring"), (2, "nothing"), (3, None), (4, "big_old_cup")]
    default = [1.0, 2.0, 3.0]
    got = encoders.attend_by_name(spark.createDataFrame(asked, "id int, name string"), "id", "name", spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, vecs, strict=True)], "c string, vec array<double>"), "c", "vec", SIZE, default, 1.5)
    got = {r.id: r.seen for r in got.collect()}
    for i, name in asked:
        scores = np.array([1.5 * len(set((name or "").split("_")) & set(n.split("_"))) for n in names] + [1.0])
        assert np.allclose(got[i], softmax_sum(scores, np.vstack([vecs, default]))), i


# gradients


def table(spark, tensors):
    return spark.createDataFrame([(p, i, j, float(x)) for p, m in tensors.items() for (i, j), x in np.ndenumerate(m) if x], gradients.SCHEMA)


def tensor(df, shape, param="w"):
    out = np.zeros(shape)
    for r in df.where(F.col("param") == param).collect():
        assert not out[r.row, r.col]
        out[r.row, r.col] = r.value
    return out


def test_sparse_gradients(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(4, 3)) * (rng.random((4, 3)) < 0.5), rng.normal(size=(4, 3)) * (rng.random((4, 3)) < 0.5)
    x, y = table(spark, {"w": a}), table(spark, {"w": b})
    assert np.allclose(tensor(gradients.accumulate(x, y, gradients.zero_gradient(spark)), (4, 3)), a + b)
    assert gradients.accumulate(x, gradients.scaled(x, -1.0)).count() == 0
    assert np.allclose(tensor(gradients.transposed(x), (3, 4)), a.T)
    wide = gradients.inflated(x, 2, 5)
    assert np.allclose(tensor(wide, (9, 9))[2:6, 5:8], a) and np.allclose(tensor(gradients.core_of(wide, (2, 6), (5, 8)), (4, 3)), a)
    top, rest = gradients.split_rows(x, 1)
    left, right = gradients.split_columns(x, 2)
    assert np.allclose(np.vstack([tensor(top, (1, 3)), tensor(rest, (3, 3))]), a) and np.allclose(np.hstack([tensor(left, (4, 2)), tensor(right, (4, 1))]), a)
    assert np.allclose(tensor(gradients.unbroadcast(x, 0), (1, 3)), a.sum(0, keepdims=True)) and np.allclose(tensor(gradients.unbroadcast(x, 1), (4, 1)), a.sum(1, keepdims=True))
    assert np.allclose(tensor(gradients.clipped(x, -0.3, 0.2), (4, 3)), a.clip(-0.3, 0.2))
    assert np.allclose(tensor(gradients.clip_norm(x, 0.1), (4, 3)), a * 0.1 / np.linalg.norm(a)) and np.allclose(tensor(gradients.clip_norm(x, 1e6), (4, 3)), a)
    assert gradients.dense(x, spark.createDataFrame([("w", 4, 3)], "param string, rows int, cols int")).count() == 12
    with pytest.raises(ValueError, match="zero"):
        gradients.clipped(x, 0.1, 1.0)


def test_sparse_steps(spark):
    """Two steps of both optimisers; cells without a gradient stay, and keep their moments."""
    w = np.arange(1.0, 7.0).reshape(2, 3)
    g1, g2 = np.array([[0.5, 0, 0], [0, -2.0, 0]]), np.array([[0.25, 1.0, 0], [0, 0, 0]])
    params = table(spark, {"w": w})
    got = gradients.sgd(gradients.sgd(params, table(spark, {"w": g1}), 0.1), table(spark, {"w": g2}), 0.1, 0.5, ["w"])
    assert np.allclose(tensor(got, (2, 3)), (w - 0.1 * g1) * 0.95 - 0.1 * g2)
    p, moments = gradients.adam(params, None, table(spark, {"w": g1}), 0.1)
    p, moments = gradients.adam(p, moments, table(spark, {"w": g2}), 0.1)
    m, v, t, want = np.zeros((2, 3)), np.zeros((2, 3)), np.zeros((2, 3)), w.copy()
    for g in (g1, g2):
        at = g != 0
        t, m, v = t + at, np.where(at, 0.9 * m + 0.1 * g, m), np.where(at, 0.999 * v + 0.001 * g * g, v)
        step = np.divide(m, 1 - 0.9**t, where=at, out=np.zeros_like(m)) / (np.sqrt(np.divide(v, 1 - 0.999**t, where=at, out=np.zeros_like(m))) + 1e-8)
        want -= 0.1 * np.where(at, step, 0)
    assert np.allclose(tensor(p, (2, 3)), want) and moments.count() == 3


def test_bag_gradient_lowers_the_loss(spark):
    """The gradient is that of finite differences, and a few steps of it lower the loss."""
    entries = [(1, 0, 2.0), (1, 1, 1.0), (2, 1, 1.0), (2, 2, 3.0), (3, 0, 1.0)]
    truth = {1: 1.0, 2: 0.0, 3: 1.0}
    e, w = np.array([[0.1, -0.2], [0.3, 0.4], [-0.5, 0.2]]), np.array([[0.7, -0.3]])

    def loss(e, w):
        out = 0.0
        for k, y in truth.items():
            rows = [(r, x) for d, r, x in entries if d == k]
            mean = sum(x * e[r] for r, x in rows) / sum(x for _, x in rows)
            p = 1 / (1 + math.exp(-float(mean @ w[0])))
            out -= y * math.log(p) + (1 - y) * math.log(1 - p)
        return out / len(truth)

    df, y = spark.createDataFrame(entries, "d int, r bigint, x double"), spark.createDataFrame(list(truth.items()), "d int, y double")
    params = table(spark, {"e": e, "w": w})
    found, losses = gradients.logistic_bag_gradient(df, "d", "r", "x", y, params, "e", "w")
    assert abs(losses.agg(F.avg("loss")).first()[0] - loss(e, w)) < 1e-9
    for m, name in ((e, "e"), (w, "w")):
        got = tensor(found, m.shape, name)
        for at in np.ndindex(m.shape):
            h = np.zeros(m.shape)
            h[at] = 1e-6
            up, down = (loss(e + h, w), loss(e - h, w)) if name == "e" else (loss(e, w + h), loss(e, w - h))
            assert abs(got[at] - (up - down) / 2e-6) < 1e-6
    params = gradients.sgd(params, found, 1.0)
    _, after = gradients.logistic_bag_gradient(df, "d", "r", "x", y, params, "e", "w")
    assert after.agg(F.avg("loss")).first()[0] < loss(e, w)


def test_seeded_vectors(spark):
    got = [r.v for r in spark.createDataFrame([("a",), ("b",), ("a",)], "k string").select(seeded_vector(F.col("k"), 50).alias("v")).collect()]
    assert got[0] == got[2] != got[1] and all(-1 <= x < 1 for v in got for x in v) and abs(np.mean(got[0] + got[1])) < 0.3
