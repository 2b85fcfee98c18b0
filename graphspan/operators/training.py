"""Training a decoder over vectors: gradients by partition, optimizer steps on the driver.

Parameters are as large as the model, never as the data.  Each step sends them
to the tasks; a task goes through its rows once and returns one gradient for
each parameter, and these are summed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import autodiff as A
from .layers import seeded_weights

Params = dict[str, np.ndarray]


@dataclass
class Sgd:
    rate: float = 0.1
    decay: float = 0.0

    def step(self, params: Params, grads: Params, scale: float = 1.0) -> Params:
        return {k: p - self.rate * scale * (grads[k] + self.decay * p) for k, p in params.items()}


@dataclass
class Adam:
    rate: float = 1e-3
    decay: float = 1e-4
    b1: float = 0.9
    b2: float = 0.999
    eps: float = 1e-8
    t: int = 0
    m: Params = field(default_factory=dict)
    v: Params = field(default_factory=dict)

    def step(self, params: Params, grads: Params, scale: float = 1.0) -> Params:
        self.t += 1
        out = {}
        for k, p in params.items():
            g = grads[k] + self.decay * p
            self.m[k] = self.b1 * self.m.get(k, 0.0) + (1 - self.b1) * g
            self.v[k] = self.b2 * self.v.get(k, 0.0) + (1 - self.b2) * g * g
            out[k] = p - self.rate * scale * (self.m[k] / (1 - self.b1**self.t)) / (np.sqrt(self.v[k] / (1 - self.b2**self.t)) + self.eps)
        return out


def clip(grads: Params, most: float) -> Params:
    n = np.sqrt(sum((g**2).sum() for g in grads.values()))
    return {k: g * min(1.0, most / max(n, 1e-12)) for k, g in grads.items()}


def initial(inputs: int, hidden: int, classes: int, seed: int = 1) -> Params:
    return {
        "hidden/w": np.array(seeded_weights("hidden", hidden, inputs, seed)).T, "hidden/b": np.zeros((1, hidden)),
        "out/w": np.array(seeded_weights("out", classes, hidden, seed)).T, "out/b": np.zeros((1, classes)),
    }


def logits(x: np.ndarray, params: dict[str, A.Node]) -> A.Node:
    return A.leaky_relu(A.lift(x) @ params["hidden/w"] + params["hidden/b"]) @ params["out/w"] + params["out/b"]


def gradient(rows: DataFrame, params: Params) -> tuple[Params, float, int]:
    """Mean gradient, mean loss and number of rows(v: array<double>, y: int)."""

    def partial(batches):
        total: Params = {k: np.zeros_like(p) for k, p in params.items()}
        loss, n = 0.0, 0
        for pdf in batches:
            if len(pdf):
                nodes = {k: A.Node(p) for k, p in params.items()}
                each = A.cross_entropy_on_softmax(logits(np.stack(pdf["v"].to_numpy()), nodes), pdf["y"].to_numpy())
                A.backprop(each.sum())
                loss, n = loss + float(each.value.sum()), n + len(pdf)
                for k in total:
                    total[k] += nodes[k].grad
        yield pd.DataFrame({"k": [*total, "loss", "n"], "g": [g.ravel().tolist() for g in total.values()] + [[loss], [float(n)]]})

    parts = rows.mapInPandas(partial, "k string, g array<double>").select("k", F.posexplode("g").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x"))
    sums: dict[str, np.ndarray] = {k: np.zeros(p.size) for k, p in params.items()} | {"loss": np.zeros(1), "n": np.zeros(1)}
    for r in parts.collect():  # one row for each number in the model
        sums[r.k][r.i] = r.x
    n = max(1.0, sums["n"][0])
    return {k: (sums[k] / n).reshape(p.shape) for k, p in params.items()}, sums["loss"][0] / n, int(sums["n"][0])


def train(rows: DataFrame, params: Params, optimizer, epochs: int, patience: int = 10, most: float = 2.0) -> tuple[Params, list[float]]:
    """The best parameters, and the losses; ends after `patience` epochs without a better loss."""
    best, best_loss, since, losses = params, float("inf"), 0, []
    for _ in range(epochs):
        grads, loss, _ = gradient(rows, params)
        losses.append(loss)
        best, best_loss, since = (params, loss, 0) if loss < best_loss - 1e-9 else (best, best_loss, since + 1)
        if since >= patience:
            break
        params = optimizer.step(params, clip(grads, most))
    return best, losses


def predict(rows: DataFrame, params: Params, id_col: str, vector_col: str) -> DataFrame:
    """id_col, candidate, prob: every class of every row."""

    def run(batches):
        for pdf in batches:
            p = A.softmax(logits(np.stack(pdf["v"].to_numpy()), {k: A.Node(x) for k, x in params.items()})).value if len(pdf) else np.zeros((0, 1))
            n, c = p.shape
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), c), "candidate": np.tile(np.arange(c), n), "prob": p.ravel()})

    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInPandas(run, "id bigint, candidate int, prob double").withColumnRenamed("id", id_col)
