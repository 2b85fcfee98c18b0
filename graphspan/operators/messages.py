"""Messages between nodes, merging them, and updating embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, leaky_relu, segment_softmax, sum_vectors


def binary_messages(relations: DataFrame) -> DataFrame:
    """dst, src, kind in both directions; self loops give none."""
    kept = relations.where("lhs <> rhs")
    return kept.select(F.col("lhs").alias("dst"), F.col("rhs").alias("src"), "category").union(kept.select("rhs", "lhs", "category")).withColumnRenamed("category", "kind")


def drop_library_messages(messages: DataFrame, library: DataFrame) -> DataFrame:
    """Without messages between two nodes of library(node)."""
    lib = library.select("node", F.lit(True).alias("lib"))
    out = messages.join(lib.select(F.col("node").alias("dst"), F.col("lib").alias("d")), "dst", "left").join(lib.select(F.col("node").alias("src"), F.col("lib").alias("s")), "src", "left")
    return out.where("NOT (coalesce(d, false) AND coalesce(s, false))").drop("d", "s")


def attention(messages: DataFrame, key: str = "dst", query: str = "query", value: str = "value", slope: float = 0.2) -> DataFrame:
    """key, vec: sum of the values weighted by the softmax of leaky-relu query-value products."""
    scored = messages.withColumn("score", leaky_relu(dot(F.col(query), F.col(value)), slope))
    weighted = scored.withColumn("alpha", segment_softmax("score", key))
    return sum_vectors(weighted.select(key, F.transform(value, lambda x: x * F.col("alpha")).alias("w")), [key], "w", "vec")


def residual(vector: Column, message: Column, weight: float = 1.0) -> Column:
    """The old vector plus weight times the merged message, if there is one."""
    return F.when(message.isNull(), vector).otherwise(F.zip_with(vector, message, lambda a, b: a + b * weight))


def residual_update(embeddings: DataFrame, merged: DataFrame, weight: float = 1.0) -> DataFrame:
    """node, vec: embeddings(node, vec) after a step by merged(dst, vec)."""
    step = merged.select(F.col("dst").alias("node"), F.col("vec").alias("message"))
    return embeddings.join(step, "node", "left").select("node", residual(F.col("vec"), F.col("message"), weight).alias("vec"))
