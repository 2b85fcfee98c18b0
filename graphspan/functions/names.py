"""Names: segmentation, similarity and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three places at which camel case is cut.
BOUNDARIES = r"(?<=[A-Z])(?=[A-Z][a-z])|(?<=[^A-Z])(?=[A-Z])|(?<=[A-Za-z])(?=[^A-Za-z])"


def segment_name(name: Column) -> Column:
    """Segments of an identifier: cut at underscores, camel case and white space,
    in lower case, without digits; a leading $ joins the segment after it.  Names
    that end in Token stay whole."""

    def cased(part: Column) -> Column:
        pieces = F.split(F.regexp_replace(part, BOUNDARIES, " "), r"\s+")
        clean = F.filter(F.transform(pieces, lambda p: F.regexp_replace(F.lower(p), "[0-9]", "")), lambda p: p != "")
        text = F.regexp_replace(F.array_join(clean, " "), r"^\$ ", r"\$")
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))

    whole = F.endswith(name, F.lit("Token"))
    return F.when(whole, F.array(name)).otherwise(F.flatten(F.transform(F.split(name, "_+"), cased)))


def name_similarity(a: Column, b: Column) -> Column:
    """How many segments two names share."""
    return F.size(F.array_intersect(a, b))


def select_by_frequency(counts: DataFrame, key: str, count: str, coverage: float, at_least: int = 0, min_count: int = 1) -> DataFrame:
    """Rows of counts above min_count, most frequent first (ties by key), as long as the share before
    a row is under coverage; at_least rows if there are so many.

    Counts are summed once, before this; running sums go range by range of the order.
    """
    from ..operators.graph import checkpointed
    from ..operators.order import running

    # the ranges, the rows in them and the total are read apart: counted once, behind a checkpoint
    kept = checkpointed(counts.select(F.col(key).alias("_key"), F.col(count).alias("_count")).where(F.col("_count") > min_count))
    ranked = running(kept, [F.desc("_count"), F.asc("_key")], {"_before": F.col("_count"), "_rank": F.lit(1)})
    total = F.broadcast(kept.agg(F.sum("_count").alias("_total")))  # one row
    covered = F.col("_before") / F.col("_total")
    # if the goal leaves fewer rows than at_least, the first at_least are taken
    return ranked.join(total).where((covered < coverage) | (F.col("_rank") < at_least)).select(F.col("_key").alias(key), F.col("_count").alias(count))
