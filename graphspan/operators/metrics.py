"""Accuracy, confusion and distribution statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import accuracy


def counted(df: DataFrame, keys: list[str], correct: Column) -> DataFrame:
    """keys, count, correct, accuracy."""
    out = df.groupBy(*keys).agg(F.count("*").alias("count"), F.coalesce(F.sum(correct.cast("long")), F.lit(0)).alias("correct"))
    return out.withColumn("accuracy", accuracy(F.col("correct"), F.col("count")))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts for every pair of a truth and a prediction that occur, zero included."""
    counts = df.groupBy(truth, predicted).count()
    dense = df.select(truth).distinct().join(df.select(predicted).distinct())
    return dense.join(counts, [truth, predicted], "left").select(F.col(truth).alias("truth"), F.col(predicted).alias("prediction"), F.coalesce("count", F.lit(0)).alias("n"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at n / 2 of the sorted values, by counts of distinct values and not by collecting them."""
    each = df.groupBy(*keys, value).count()
    w = Window.partitionBy(*keys)
    runs = each.withColumn("upto", F.sum("count").over(w.orderBy(value))).withColumn("half", F.floor(F.sum("count").over(w) / 2))
    return runs.where("upto > half").groupBy(*keys).agg(F.min(value).alias("median"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """In bits, of two columns: one row, column mi."""
    joint = df.groupBy(x, y).count()
    n = F.sum("count").over(Window.partitionBy())
    pxy, px, py = F.col("count") / n, F.sum("count").over(Window.partitionBy(x)) / n, F.sum("count").over(Window.partitionBy(y)) / n
    return joint.select((pxy * F.log2(pxy / (px * py))).alias("part")).agg(F.sum("part").alias("mi"))


def r_squared(df: DataFrame, y: Column, p: Column, w: Column) -> DataFrame:
    """Weighted; the mean is divided by the number of rows.  One row, column r2."""
    rows = df.select(y.alias("y"), p.alias("p"), w.alias("w"))
    mean = rows.agg((F.sum(F.col("y") * F.col("w")) / F.count("*")).alias("mean"))
    both = rows.join(F.broadcast(mean))
    return both.agg((1 - F.sum(F.pow(F.col("y") - F.col("p"), F.lit(2.0)) * F.col("w")) / F.sum(F.pow(F.col("y") - F.col("mean"), F.lit(2.0)) * F.col("w"))).alias("r2"))
