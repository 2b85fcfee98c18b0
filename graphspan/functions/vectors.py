"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def clip_norm(v: Column, most: float) -> Column:
    n = norm(v)
    return F.when(n > most, F.transform(v, lambda x: x * F.lit(most) / n)).otherwise(v)


def one_hot(i: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == i, 1.0).otherwise(0.0))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def segment_softmax(score: str, *keys: str) -> Column:
    """Softmax of a score within the rows of a key, shifted by the largest."""
    w = Window.partitionBy(*keys)
    shifted = F.exp(F.col(score) - F.max(score).over(w))
    return shifted / F.sum(shifted).over(w)


def sum_vectors(df: DataFrame, keys: list[str], vector: str, out: str, mean: bool = False) -> DataFrame:
    """Element-wise sum or mean of a vector column for each key.

    Elements are summed by (key, position), which combines before the shuffle
    however many rows a key has.
    """
    total_of = F.avg("x") if mean else F.sum("x")
    parts = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(total_of.alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(out))


def cross_entropy_softmax(logits: Column, target: Column) -> Column:
    """Of an array of logits and the index of the truth, shifted by the largest."""
    top = F.array_max(logits)
    return F.log(total(F.transform(logits, lambda x: F.exp(x - top)))) + top - F.element_at(logits, target + 1)


def cross_entropy_sigmoid(z: Column, target: Column) -> Column:
    soft = F.log(1 + F.exp(-z))
    return soft * target + (1 - target) * (z + soft)


def seeded_vector(key: Column, size: int, seed: int = 1) -> Column:
    """A vector in [-1, 1) that depends on nothing but the key as text and the seed."""
    digest = lambda i: F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), i.cast("string")).cast("binary"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(digest(i), 1, 12), 16, 10).cast("double") / float(1 << 47) - 1)


def unit(v: Column) -> Column:
    """The vector by its norm; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def sum_arrays(df: DataFrame, keys: list[str], vector: str, size: int, out: str, count: str | None = None) -> DataFrame:
    """keys, out[, count]: element-wise sums of vectors of a known small size, each element an aggregate of its own.

    One row of sums for each key and task is shuffled, however many rows a key has.
    """
    sums = [F.sum(F.get(vector, F.lit(i))).alias(f"_s{i}") for i in range(size)]
    rows = df.groupBy(*keys).agg(*sums, *([F.count("*").alias(count)] if count else []))
    return rows.select(*keys, F.array(*[f"_s{i}" for i in range(size)]).alias(out), *([count] if count else []))
