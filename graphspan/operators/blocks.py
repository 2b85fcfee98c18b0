"""Layers over blocks of rows, and attention in mergeable parts.

The vectors of an Arrow batch are stacked to a matrix and multiplied once for
each kind of row.  What is summed by a key is summed within the batch first: rows
are sorted by key and segments summed in one pass, so that a key gives one row for each batch
however many rows it has.  Softmax-weighted sums are kept as (largest score, sum
of weights, weighted sum), which can be put together in any order, so neither the
rows of a key nor a set of keys has to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .graph import checkpointed

#: Keys in a block, and queries in a block, of attention over a set of keys.
BLOCK = 2048


@dataclass
class Layer:
    """x -> activation(weights x + bias); weights has a row for each output."""

    weights: list[list[float]]
    bias: list[float] | None = None
    activation: str = "relu"
    matrix: np.ndarray = field(init=False)

    def __post_init__(self):
        self.matrix = np.array(self.weights, dtype=float)
        if self.activation not in ("relu", "none", "tanh"):
            raise ValueError(f"unknown activation: {self.activation}")

    @property
    def size(self) -> int:
        return self.matrix.shape[0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.matrix.T + (0.0 if self.bias is None else np.array(self.bias))
        return np.maximum(y, 0.0) if self.activation == "relu" else np.tanh(y) if self.activation == "tanh" else y


def stacked(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def rows_of(matrix: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix, dtype=float).reshape(-1)))


def by_kind(kinds: list[str], x: np.ndarray, layers: dict[str, Layer]) -> np.ndarray:
    """Each row through the layer of its kind: the rows of a kind are one product of matrices."""
    size = next(iter(layers.values())).size
    out = np.zeros((len(x), size))
    names, code = np.unique(np.array(kinds, dtype=object).astype(str), return_inverse=True)
    for i, name in enumerate(names):
        at = np.flatnonzero(code == i)
        out[at] = layers[name](x[at])
    return out


def segment_sums(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first row, number of rows and sum of x for each distinct key code."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.zeros(0, int)
    return order[first], np.diff(np.append(first, len(keys))), np.add.reduceat(x[order], first, axis=0) if len(keys) else x


def _mapped(df: DataFrame, work: Callable[[pa.RecordBatch], list[pa.Array]], schema: StructType) -> DataFrame:
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(work(batch), names)

    return df.mapInArrow(run, schema)


def apply_layers(rows: DataFrame, kind: str, vectors: list[str], layers: dict[str, Layer], out: str) -> DataFrame:
    """rows with `out`: the vectors of a row, one after the other, through the layer of its kind.

    A kind without a layer, a null vector or vectors of unequal sizes are errors; vectors of a kind's rows must have
    the size that its layer takes.
    """
    rows = rows.where(F.expr(" AND ".join(f"{v} IS NOT NULL" for v in vectors)))
    schema = StructType([*rows.schema.fields, StructField(out, ArrayType(DoubleType()))])
    at = [rows.columns.index(c) for c in (kind, *vectors)]

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        x = np.concatenate([stacked(batch.column(i)) for i in at[1:]], axis=1)
        return [*batch.columns, rows_of(by_kind(batch.column(at[0]).to_pylist(), x, layers))]

    return _mapped(rows, work, schema)


def summed_layers(rows: DataFrame, key: str, kind: str, vectors: list[str], layers: dict[str, Layer], out: str, mean: bool = False) -> DataFrame:
    """key, n, out: sum (or mean) for each key of its rows' vectors after the layers of their kinds.

    The messages themselves are never shuffled, only a sum for each key and batch.
    """
    size = next(iter(layers.values())).size
    rows = rows.select(key, kind, *vectors)
    schema = StructType([rows.schema[0], StructField("n", LongType()), StructField("s", ArrayType(DoubleType()))])

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        x = np.concatenate([stacked(batch.column(i + 2)) for i in range(len(vectors))], axis=1)
        y = by_kind(batch.column(1).to_pylist(), x, layers)
        codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
        first, n, sums = segment_sums(codes, y)
        return [batch.column(0).take(pa.array(first)), pa.array(n), rows_of(sums)]

    parts = _mapped(rows, work, schema)
    sums = [F.sum(F.get("s", F.lit(i))).alias(f"_{i}") for i in range(size)]
    whole = parts.groupBy(key).agg(F.sum("n").alias("n"), *sums)
    return whole.select(key, "n", F.array(*[(F.col(f"_{i}") / F.col("n") if mean else F.col(f"_{i}")) for i in range(size)]).alias(out))


def gram(rows: DataFrame, vector: str) -> DataFrame:
    """i, j, dot: the matrix of all vectors, transposed, times itself: a product for each Arrow batch, then sums of these."""
    schema = StructType.fromDDL("i int, j int, x double")

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        x = stacked(batch.column(0))
        size = x.shape[1]
        i, j = np.divmod(np.arange(size * size, dtype=np.int32), size)
        return [pa.array(i), pa.array(j), pa.array((x.T @ x).reshape(-1))]

    return _mapped(rows.select(vector), work, schema).groupBy("i", "j").agg(F.sum("x").alias("dot"))


# attention

PARTS = "m double, s double, w array<double>"


def softmax_parts(codes: np.ndarray, scores: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first row, largest score, sum of weights and weighted sum of values for each distinct code."""
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], codes[order][1:] != codes[order][:-1]]))
    n = np.diff(np.append(first, len(codes)))
    most = np.maximum.reduceat(scores[order], first)
    weight = np.exp(scores[order] - np.repeat(most, n))
    return order[first], most, np.add.reduceat(weight, first), np.add.reduceat(weight[:, None] * values[order], first, axis=0)


def merged_parts(parts: DataFrame, key: str, size: int, out: str) -> DataFrame:
    """key, out: the softmax-weighted sums that parts(key, m, s, w) stand for.

    The largest score of a key comes first; then parts are scaled to it and summed,
    combined before the shuffle.  The rows of a key do not come to one task.
    """
    parts = checkpointed(parts)
    most = parts.groupBy(F.col(key).alias("_k")).agg(F.max("m").alias("_most"))
    scaled = parts.join(most, F.col(key).eqNullSafe(F.col("_k"))).select(key, (F.col("s") * F.exp(F.col("m") - F.col("_most"))).alias("s"), F.transform("w", lambda x: x * F.exp(F.col("m") - F.col("_most"))).alias("w"))
    sums = scaled.groupBy(key).agg(F.sum("s").alias("_s"), *[F.sum(F.get("w", F.lit(i))).alias(f"_{i}") for i in range(size)])
    return sums.select(key, F.array(*[F.col(f"_{i}") / F.col("_s") for i in range(size)]).alias(out))


def leaky(x: np.ndarray, slope: float) -> np.ndarray:
    return np.where(x > 0, x, x * slope)


def attended_messages(rows: DataFrame, key: str, query: str, value: str, heads: list[tuple[Layer, Layer, Layer]], out: str, slope: float = 0.2) -> DataFrame:
    """key, out: for each head the values of a key's rows weighted by the softmax of leaky products, one head after the other.

    A head is three layers: of the key's own vector (`query`), of a message's key
    and of its value.  All of a batch's rows go through a layer at once.
    """
    size = sum(v.size for _, _, v in heads)
    rows = rows.select(key, query, value)
    schema = StructType([rows.schema[0], *StructType.fromDDL("head int, " + PARTS).fields])

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        q, x = stacked(batch.column(1)), stacked(batch.column(2))
        codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
        out = []
        for h, (own, other, values) in enumerate(heads):
            first, m, s, w = softmax_parts(codes, leaky((own(q) * other(x)).sum(1), slope), values(x))
            out.append([batch.column(0).take(pa.array(first)), pa.array(np.full(len(m), h, np.int32)), pa.array(m), pa.array(s), rows_of(w)])
        return [pa.concat_arrays([o[i] for o in out]) for i in range(5)]

    parts = _mapped(rows, work, schema)
    if len(heads) == 1:
        return merged_parts(parts.drop("head"), key, size, out)
    keyed = parts.select(F.struct(key, "head").alias("_kh"), "m", "s", "w")
    merged = merged_parts(keyed, "_kh", max(v.size for _, _, v in heads), "_v").select(F.col(f"_kh.{key}").alias(key), "_kh.head", F.slice("_v", 1, F.element_at(F.array(*[F.lit(v.size) for _, _, v in heads]), F.col("_kh.head") + 1)).alias("_v"))
    ordered = F.sort_array(F.collect_list(F.struct("head", "_v")))  # one entry for each head
    return merged.groupBy(key).agg(F.flatten(F.transform(ordered, lambda p: p["_v"])).alias(out))


def in_blocks(rows: DataFrame, name: str, *columns: str, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(name, columns) and the number of blocks: rows packed to lists of at most `block`, one row for each list; name numbers them from 0 without gaps.

    Rows stay where they are: a task packs its own, and lists are numbered from the number of lists in each task.
    """
    rows = checkpointed(rows.select(*columns))  # two passes see the same rows in the same tasks
    sizes = {r["p"]: -(-r["n"] // block) for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}  # a number for each task
    starts, at = {}, 0
    for p in sorted(sizes):
        starts[p], at = at, at + sizes[p]
    schema = StructType([StructField(name, IntegerType()), *[StructField(c, ArrayType(rows.schema[c].dataType)) for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = starts.get(TaskContext.get().partitionId(), 0), []

        def packed(table: pa.Table) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table[c].combine_chunks()) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *lists], schema.names)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= block:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, block))
                number += 1
                held = table.slice(block).to_batches()
        if sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema), at


def attended_set(queries: DataFrame, id_col: str, query: str, keys: DataFrame, key: str, value: str, out: str, default: tuple[list[float], list[float]] | None = None, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, block: int = BLOCK, times: str | None = None) -> DataFrame:
    """id, out: for each query the sum of all keys' values, weighted by the softmax of the products of query and keys.

    Blocks of queries meet blocks of keys by the number of the block; a task holds
    one of each and gives (largest score, sum, weighted sum) for each query, so
    neither side has to fit a task.  Keys that are equal in key and value meet a query once, with
    their number; times: a column of keys that says how often each stands for itself (more than 0).  default: a key and a value that belong to every query's set.
    score(queries, keys): another matrix of scores than that of products.
    """
    blocks, _ = in_blocks(queries.select(id_col, F.col(query).alias("_q")), "_qb", id_col, "_q", block=block)
    rows = keys.select(F.col(key).alias("_key"), F.col(value).alias("_value"), (F.lit(1.0) if times is None else F.col(times).cast("double")).alias("_n"))
    if default is not None:
        own = queries.sparkSession.createDataFrame([(*map(list, default), 1.0)], "_key array<double>, _value array<double>, _n double")
        rows = rows.union(own)
    rows = rows.groupBy("_key", "_value").agg(F.sum("_n").alias("_n"))
    key_blocks, n = in_blocks(rows, "_kb", "_key", "_value", "_n", block=block)
    size = len(default[1]) if default is not None else len(keys.select(value).first()[0])
    asked = blocks.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))))
    met = asked.join(key_blocks, F.col("_at") == F.col("_kb")).select(id_col, "_q", "_key", "_value", "_n")
    schema = StructType([queries.schema[id_col], *StructType.fromDDL(PARTS).fields])
    product = score or (lambda q, k: q @ k.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, q, k, v, number = (batch.column(i)[r].values for i in range(5))
                q, k, v = stacked(q), stacked(k), stacked(v)
                scores = product(q, k)
                m = scores.max(1)
                weight = np.exp(scores - m[:, None]) * number.to_numpy()
                yield pa.RecordBatch.from_arrays([ids, pa.array(m), pa.array(weight.sum(1)), rows_of(weight @ v)], schema.names)

    return merged_parts(met.mapInArrow(run, schema), id_col, size, out)
