"""Splits, sampling, filters and batches of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sampling_key
from .order import numbered, running


def divide(projects: DataFrame, key: str, test: int, dev: int, seed: int = 1) -> DataFrame:
    """projects with split: the first `test` by hash, the next `dev`, the rest train.

    Only the head is ranked: the cut between the splits comes from the test + dev
    least hashes, so the table of projects is not ordered as a whole.
    """
    keyed = projects.withColumn("_h", sampling_key(seed, F.col(key)))
    head = keyed.select(key, "_h").orderBy("_h", key).limit(test + dev)
    ranked = head.withColumn("_i", F.row_number().over(Window.orderBy("_h", key))).select(F.col(key).alias("_key"), "_i")
    split = F.when(F.col("_i") <= test, "test").when(F.col("_i") <= test + dev, "dev").otherwise("train")
    return keyed.join(F.broadcast(ranked), F.col(key) == F.col("_key"), "left").withColumn("split", split).drop("_h", "_i", "_key")


def keep_fraction(df: DataFrame, keys: list[str], item: str, fraction: float, seed: int) -> DataFrame:
    """floor(fraction * n) items of each key, chosen by hash."""
    order = Window.partitionBy(*keys).orderBy("_h", item)
    rows = df.withColumn("_h", sampling_key(seed, F.col(item))).withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return rows.where(F.col("_i") <= F.floor(F.col("_n") * fraction)).drop("_h", "_i", "_n")


def position_batches(sequences: DataFrame, key: str, length: str) -> DataFrame:
    """pos, batch_size: how many sequences are longer than each position."""
    return sequences.select(F.explode(F.sequence(F.lit(0), F.col(length).cast("int") - 1)).alias("pos")).groupBy("pos").agg(F.count("*").alias("batch_size"))


def destination(nodes: Column, predicates: Column, annotations: Column, lib: Column, least: int, most: int) -> Column:
    """Where a project goes by its size and its labels."""
    return (
        F.when(~nodes.between(least, most), "TooBigOrSmall")
        .when(annotations * 10 < predicates, "TooFewLabels")
        .when((annotations - lib) * 10 < lib, "TooFewProjectLabels")
        .otherwise("filteredRepos")
    )


def select_points(rows: DataFrame, key: str, order: str, most: int, seed: int = 1) -> DataFrame:
    """At most so many rows of each key, by a hash of key and order, and always the last one; all rows where there are no more.

    The rows of a key are ranked by window, which sorts and spills but holds no list.
    """
    by_key = Window.partitionBy(key)
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col(order).cast("string")).cast("binary"))
    last = F.col(order) == F.max(order).over(by_key)
    ranked = rows.withColumn("_rank", F.row_number().over(by_key.orderBy(F.when(last, 0).otherwise(1), draw, order)))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def indexed_set(rows: DataFrame, column: str) -> DataFrame:
    """column, idx: its distinct values by first appearance in their own order, numbered from 0 range by range."""
    return numbered(rows.select(column).distinct(), [column], "idx")


def uniform_sample(indexed: DataFrame, column: str, n: int, seed: int = 1) -> DataFrame:
    """n values of an indexed set, each as likely as any other; the choice depends on the seed alone."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("idx").cast("string")).cast("binary"))
    return indexed.orderBy(draw, "idx").limit(n).select(column, "idx")


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a, once a join has shown that no key of it is in b; else an error."""
    both = a.select(key).join(b.select(key).distinct(), key, "left_semi")
    found = both.limit(1).collect()
    if found:
        raise ValueError(f"{key} {found[0][0]} is in both")
    return a


def stack_positions(chains: DataFrame, key: str, length: str) -> DataFrame:
    """chains with `start`: the lengths of all chains before, in the order of key."""
    return running(chains, [key], {"start": F.col(length)})
