import numpy as np
import pytest
from graphspan.operators import autodiff as A
from graphspan.operators import training

RNG = np.random.default_rng(3)
X = RNG.normal(size=(3, 4))
POS = np.abs(RNG.normal(size=(3, 4))) + 0.5
ROW = RNG.normal(size=(1, 4))
W = RNG.normal(size=(4, 2))
CASES = {
    "add rows": (X, lambda x: x + A.Node(ROW)), "row added": (ROW, lambda x: A.Node(X) + x), "sub": (X, lambda x: A.Node(POS) - x), "mul": (X, lambda x: x * x), "div": (POS, lambda x: A.Node(X) / x), "neg": (X, lambda x: -x), "pow": (POS, lambda x: x**3),
    "dot": (X, lambda x: x @ A.Node(W)), "dot right": (W, lambda x: A.Node(X) @ x), "slice": (X, lambda x: x[1:, :2] * 2.0), "transpose": (X, lambda x: x.T @ A.Node(POS)), "sum": (X, lambda x: x.sum(0) * x.sum()), "mean": (X, lambda x: x.mean(1) * x.mean()),
    "exp": (X, A.exp), "log": (POS, A.log), "sqrt": (POS, A.sqrt), "abs": (X, A.absolute), "sigmoid": (X, A.sigmoid), "tanh": (X, A.tanh), "relu": (X, A.relu), "leaky": (X, A.leaky_relu), "max": (X, lambda x: A.maximum(x, A.Node(ROW))),
    "softmax": (X, lambda x: A.softmax(x) * A.Node(POS)), "concat": (X, lambda x: A.concat([x * 2.0, A.sigmoid(x)]) ** 2), "ce softmax": (X, lambda x: A.cross_entropy_on_softmax(x, np.array([0, 3, 1]))),
    "ce sigmoid": (X, lambda x: A.cross_entropy_on_sigmoid(x, (POS > 1).astype(float))), "used twice": (X, lambda x: A.tanh(x) * x + A.exp(x)),
}


@pytest.mark.parametrize("name", CASES)
def test_gradients_against_differences(name):
    start, f = CASES[name]
    x = A.Node(start)
    A.backprop(f(x).sum())
    numeric = np.zeros_like(start)
    for at in np.ndindex(start.shape):
        up, down = start.copy(), start.copy()
        up[at] += 1e-6
        down[at] -= 1e-6
        numeric[at] = (f(A.Node(up)).value.sum() - f(A.Node(down)).value.sum()) / 2e-6
    assert np.allclose(x.grad, numeric, atol=1e-5)


def test_optimizers():
    p = {"a": np.array([1.0])}
    assert training.Sgd(0.5, 0.1).step(p, {"a": np.array([2.0])})["a"][0] == pytest.approx(1 - 0.5 * 2.1)
    assert training.Adam(0.1, 0.0).step(p, {"a": np.array([2.0])})["a"][0] == pytest.approx(0.9, abs=1e-6)
    assert np.sqrt(sum((g**2).sum() for g in training.clip({"a": np.array([3.0, 4.0])}, 1.0).values())) == pytest.approx(1.0)


def test_training_learns_and_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 120)
    x = np.eye(3)[y] + rng.normal(size=(120, 3)) * 0.2
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(120)], "id long, v array<double>, y int").repartition(3)
    start = training.initial(3, 5, 3)
    one, many = training.gradient(rows.coalesce(1), start), training.gradient(rows, start)
    assert one[2] == many[2] == 120 and all(np.allclose(one[0][k], many[0][k]) for k in start)
    params, losses = training.train(rows, start, training.Adam(0.1), 12)
    assert losses[-1] < 0.5 * losses[0]
    best = training.predict(rows, params, "id", "v").toPandas().sort_values(["id", "prob"]).groupby("id").last()
    assert (best["candidate"].to_numpy() == y).mean() > 0.9
