"""Connected components over any number of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sweep

#: More rounds than that do not occur: each at least halves the longest path.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour.

    The smallest neighbours are behind a checkpoint: both sides of the join are then
    plain shuffles, so the links of a node with very many neighbours can be split.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")))
    return both.where("b > a").join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them.  edges: a > b."""
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b: bigint) -> id, component: the smallest id reachable, for every id in edges.

    Neither links nor components come to the driver, only a count and a sum of
    hashes for each round.  Self links are allowed; nulls are not.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    ids = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    ids = cut(ids)
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        stars = cut(_small_star(_large_star(stars)))
        now = stars.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == mark:
            break
        mark = now
        sweep(edges.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    return ids.join(stars.select(F.col("a").alias("s"), F.col("b").alias("root")), F.col("id") == F.col("s"), "left").select("id", F.coalesce("root", "id").alias("component"))
