"""Reading tables, and mapping ordinary tables to nodes, edges, names and annotations.

The mappings are choices made here so that operators over program graphs can run
on order data: a node is a tagged key, an order line is a field of its order, a
part's name is an identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Parquet tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def words(texts: DataFrame, column: str = "text") -> DataFrame:
    """One row per whitespace-separated token, column `word`."""
    return texts.select(F.explode(F.split(F.col(column), r"\s+")).alias("word")).where("word <> ''")


def nodes(t: Tables) -> DataFrame:
    """node (tag:key), is_type, from_lib, name."""
    made = lambda df, tag, key, name, is_type, lib: df.select(F.concat(F.lit(tag + ":"), F.col(key).cast("string")).alias("node"), F.lit(is_type).alias("is_type"), F.lit(lib).alias("from_lib"), F.col(name).alias("name"))
    return (
        made(t.region, "r", "r_regionkey", "r_name", True, True)
        .union(made(t.nation, "n", "n_nationkey", "n_name", True, True))
        .union(made(t.customer, "c", "c_custkey", "c_name", True, False))
        .union(made(t.supplier, "s", "s_suppkey", "s_name", True, False))
    )


def binary_relations(t: Tables) -> DataFrame:
    """lhs, rhs, category of the relations between nodes."""
    rel = lambda df, a, ka, b, kb, category: df.select(F.concat(F.lit(a + ":"), F.col(ka).cast("string")).alias("lhs"), F.concat(F.lit(b + ":"), F.col(kb).cast("string")).alias("rhs"), F.lit(category).alias("category"))
    return (
        rel(t.nation, "n", "n_nationkey", "r", "n_regionkey", "inheritance")
        .union(rel(t.customer, "c", "c_custkey", "n", "c_nationkey", "subtype"))
        .union(rel(t.supplier, "s", "s_suppkey", "n", "s_nationkey", "equal"))
        .union(rel(t.orders, "o", "o_orderkey", "c", "o_custkey", "assign"))
    )
