"""Top-n distributions over candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import segment_softmax


def top_n(scores: DataFrame, keys: list[str], score: str, candidate: str, n: int, softmax: bool = True) -> DataFrame:
    """The n best candidates of each key with their rank (from 1) and probability."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(candidate))
    out = scores.withColumn("prob", segment_softmax(score, *keys)) if softmax else scores
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best(scores: DataFrame, keys: list[str], score: str, candidate: str) -> DataFrame:
    """The best candidate of each key; the least of equals.  Combines before the shuffle."""
    return scores.groupBy(*keys).agg(F.max_by(candidate, F.struct(score, -F.col(candidate))).alias(candidate))


def sample_by_weight(items: DataFrame, keys: list[str], item: str, weight: str, p: Column) -> DataFrame:
    """For each key the first item, in item order, at which the running weight reaches p of the total."""
    w = Window.partitionBy(*keys).orderBy(item)
    rows = items.withColumn("running", F.sum(weight).over(w)).withColumn("goal", p * F.sum(weight).over(Window.partitionBy(*keys)))
    return rows.where("running >= goal").groupBy(*keys).agg(F.min(item).alias(item))
