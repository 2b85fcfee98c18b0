"""Layers over vectors held as arrays of doubles; weights are small literals."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def seeded_weights(path: str, rows: int, columns: int, seed: int = 1) -> list[list[float]]:
    """Weights that depend on the parameter's path and the seed, in [-b, b] with b = sqrt(6 / (rows + columns)), to 6 places."""
    bound = (6.0 / (rows + columns)) ** 0.5
    unit = lambda i, j: int(hashlib.md5(f"{seed}|{path}|{i}|{j}".encode()).hexdigest()[:12], 16) / float(1 << 48)
    return [[round((2 * unit(i, j) - 1) * bound, 6) for j in range(columns)] for i in range(rows)]


def linear(v: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """weights has a row for each output."""
    bias = bias or [0.0] * len(weights)
    return F.array(*[dot(v, vector(w)) + b for w, b in zip(weights, bias, strict=True)])


def dropout(v: Column, key: Column, keep: float, seed: int = 1) -> Column:
    """Each element stays with probability keep by a hash of key and position, and is scaled by 1 / keep."""
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.transform(v, lambda x, i: F.when(draw(i) < keep, x / keep).otherwise(0.0))


def batch_norm(rows: DataFrame, value: str, eps: float = 1e-5) -> Column:
    """A value less its mean over its standard deviation, over all rows.

    The two moments come from one aggregation and are joined to the rows.
    """
    moments = rows.agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    return rows.join(F.broadcast(moments)).withColumn(value, (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + eps)).drop("_m", "_v")


def running_moments(rows: DataFrame, batch: str, value: str, momentum: float = 0.9) -> DataFrame:
    """batch, mean, variance: moments as training keeps them, momentum * old + (1 - momentum) * those of the batch, in the order of batches.

    One row per batch; rows are summed before they are shuffled.
    """
    own = rows.groupBy(batch).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    past = F.sort_array(F.collect_list(F.struct(batch, "m", "v")).over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)))
    mixed = lambda c, start: F.aggregate("past", F.lit(start), lambda old, x: old * momentum + x[c] * (1 - momentum))
    return own.withColumn("past", past).select(batch, mixed("m", 0.0).alias("mean"), mixed("v", 1.0).alias("variance"))


def encode_position(position: Column, size: int, wave: float = 10_000.0) -> Column:
    """Sines and cosines of a position from -1 on, in turns, of falling frequencies."""
    angle = lambda i: position / F.pow(F.lit(wave), (i - i % 2) / float(size))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))


def multi_head_attention(messages: DataFrame, key: str, query: str, value: str, heads: list[list[list[float]]], slope: float = 0.2) -> DataFrame:
    """key, vec: for each head (a matrix, a row for each output) the values it makes, weighted by the softmax of leaky products with the query it makes, one after the other."""
    from .messages import attention

    out = None
    for k, matrix in enumerate(heads):
        seen = messages.select(key, linear(F.col(query), matrix).alias("q"), linear(F.col(value), matrix).alias("x"))
        one = attention(seen, key, "q", "x", slope).withColumnRenamed("vec", f"h{k}")
        out = one if out is None else out.join(one, key)
    return out.select(key, F.concat(*[f"h{k}" for k in range(len(heads))]).alias("vec"))


def sigmoid_of(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Gru:
    """A gated recurrent unit: weights has, for the gates z and r and the candidate, a matrix for the input and one for the state."""

    def __init__(self, weights: dict[str, list[list[float]]]):
        self.w = {k: np.array(v, dtype=float) for k, v in weights.items()}
        self.size = len(self.w["wz"])

    def start(self) -> np.ndarray:
        return np.zeros(self.size)

    def step(self, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        w = self.w
        z, r = sigmoid_of(w["wz"] @ x + w["uz"] @ h), sigmoid_of(w["wr"] @ x + w["ur"] @ h)
        return (1 - z) * h + z * np.tanh(w["wh"] @ x + r * (w["uh"] @ h))

    def output(self, h: np.ndarray) -> np.ndarray:
        return h


class Lstm(Gru):
    """Long short-term memory: gates i, f, o and the candidate g; the state is the output and the cell."""

    def __init__(self, weights: dict[str, list[list[float]]], forget_bias: float = 1.0):
        self.w = {k: np.array(v, dtype=float) for k, v in weights.items()}
        self.size, self.bias = len(self.w["wi"]), forget_bias

    def start(self) -> np.ndarray:
        return np.zeros(2 * self.size)

    def step(self, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        w, h, c = self.w, state[: self.size], state[self.size :]
        i, f, o = (sigmoid_of(w[f"w{g}"] @ x + w[f"u{g}"] @ h + (self.bias if g == "f" else 0.0)) for g in "ifo")
        c = f * c + i * np.tanh(w["wg"] @ x + w["ug"] @ h)
        return np.concatenate([o * np.tanh(c), c])

    def output(self, state: np.ndarray) -> np.ndarray:
        return state[: self.size]


def seeded_cell(kind: str, path: str, inputs: int, size: int, seed: int = 1) -> Gru:
    gates = "zrh" if kind == "gru" else "ifog"
    weights = {f"{m}{g}": seeded_weights(f"{path}/{m}{g}", size, inputs if m == "w" else size, seed) for g in gates for m in "wu"}
    return Gru(weights) if kind == "gru" else Lstm(weights)


def recurrent(rows: DataFrame, key: str, order: str, value: str, cell: Gru, every: bool = False, reverse: bool = False) -> DataFrame:
    """key, [order,] state (array<double>): the cell's outputs over the rows of each key in order.

    value: an array of doubles.  With every, a row for each step, else the last
    output only.  A key's rows are sorted in one task and stream through it, so
    memory does not grow with them; the steps of one key cannot be shared out.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"{key} {fields[key]}, " + (f"{order} {fields[order]}, " if every else "") + "state array<double>"
    names = [key, *([order] if every else []), "state"]
    dealt = rows.select(key, order, F.col(value).alias("_x")).repartition(key).sortWithinPartitions(key, F.desc(order) if reverse else F.asc(order))

    def run(frames):
        now, state = None, None
        for frame in frames:
            out = []
            for k, at, x in zip(frame[key], frame[order], frame["_x"], strict=True):
                if now is None or k != now[0]:
                    if now is not None and not every:
                        out.append((now[0], cell.output(state)))
                    now, state = (k,), cell.start()
                state = cell.step(state, np.asarray(x, dtype=float))
                if every:
                    out.append((k, at, cell.output(state)))
            yield pd.DataFrame(out, columns=names)
        if now is not None and not every:
            yield pd.DataFrame([(now[0], cell.output(state))], columns=names)

    return dealt.mapInPandas(run, schema)


def bidirectional(rows: DataFrame, key: str, order: str, value: str, forward: Gru, backward: Gru) -> DataFrame:
    """key, order, state: what both cells have seen up to a row, from either end, one after the other."""
    there = recurrent(rows, key, order, value, forward, every=True)
    back = recurrent(rows, key, order, value, backward, every=True, reverse=True).withColumnRenamed("state", "back")
    return there.join(back, [key, order]).select(key, order, F.concat("state", "back").alias("state"))
