"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words.  A document first gets the whole
copies that are certain (the integer part of its expected copies); the
fractional part is an inclusion probability p, and documents are ranked by
random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``.  The sample
is the head of that ranking whose words come nearest to what the target still
lacks, so its size in words is fixed whatever the random numbers are.

A source may hold any share of the rows: a histogram of the ranking is summed
before the shuffle, and only documents of the one bin that the cut falls into
are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small, unit

#: Weights by position of the source, repeated.
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
BINS = 2048


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source of sizes(source, size): source, source_size, target.

    Sources in code point order, null last, weigh `weights`, repeating.  A target
    stops at max_copies times its source's size; the excess goes to the others by
    weight.  With c = cap / weight ascending, all targets are min(cap, level *
    weight) and the level follows from running sums.  The table has one row per
    source, so its window over all sources is as large as the list of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights) + 1)
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        per.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(max_copies))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    )
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(first, F.col("ratio")) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def with_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, seed: int, keep: list[str]) -> DataFrame:
    """keep, and the columns that ranking needs: mix_id, mix_source, size, u, w."""
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    return docs.select(
        *keep,
        F.col(id_col).alias("mix_id"),
        F.col(source_col).cast("string").alias("mix_source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("mix_size"),
        unit(F.col(id_col), seed).alias("mix_u"),
        F.when(weight > 0, weight).otherwise(1.0).alias("mix_w"),
    )


def _q():
    """Random odds over inclusion odds; null where nothing is left to sample."""
    return F.when((F.col("p") > 0) & (F.col("p") < 1), (F.col("mix_u") / (1 - F.col("mix_u"))) / (F.col("mix_w") * F.col("p") / (1 - F.col("p"))))


def source_cuts(sized: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, bins: int = BINS) -> DataFrame:
    """One row per source: its size and target, the certain whole copies, the
    inclusion probability p of one more, and the rank q_cut up to which documents get it."""
    targets = (
        source_targets(sized.select(F.col("mix_source").alias("source"), F.col("mix_size").alias("size")), weights, max_copies)
        .withColumn("expected", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
        .withColumn("whole", F.floor(F.col("expected") + 1e-12).cast("long"))
        .withColumn("p", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
        .withColumn("lacks", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
        .drop("expected")
    )
    targets = cut(targets)
    ranked = sized.where("mix_size > 0").join(small(targets), F.col("mix_source").eqNullSafe(F.col("source"))).withColumn("q", _q()).where("q IS NOT NULL")
    # the rank as a number in [0, 1): q / (1 + q) grows with q
    ranked = ranked.select("source", "lacks", "mix_id", "mix_size", "q", F.least(F.lit(bins - 1), F.floor(F.col("q") / (1 + F.col("q")) * bins)).alias("bin"))
    runs = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    histogram = ranked.groupBy("source", "bin").agg(F.sum("mix_size").alias("words"), F.first("lacks").alias("lacks")).withColumn("before", F.coalesce(F.sum("words").over(runs), F.lit(0)))
    # the cut lies in the first bin that reaches what is lacking
    edges = histogram.where("before + words > lacks").groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bin", "before")).alias("edge"))
    edges = cut(edges.select("s", F.col("edge.bin").alias("edge_bin"), F.col("edge.before").alias("edge_before")))
    order = Window.partitionBy("source").orderBy("q", "mix_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranked.join(small(edges), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("edge_bin")))
    inside = inside.withColumn("start", F.col("edge_before") + F.coalesce(F.sum("mix_size").over(order), F.lit(0)))
    last = inside.where("start + mix_size / 2.0 <= lacks").groupBy("source").agg(F.max("q").alias("last"))
    bin_start = F.col("edge_bin") / bins / (1 - F.col("edge_bin") / bins)
    # without an edge the whole source is taken; with one, up to the last document before the cut
    found = edges.join(last, F.col("s").eqNullSafe(F.col("source")), "left").select("s", F.coalesce("last", bin_start - 1e-300).alias("q_edge"), F.lit(True).alias("has_edge"))
    return (
        targets.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
        .withColumn("q_cut", F.when(F.col("has_edge"), F.col("q_edge")).otherwise(F.lit(float("inf"))))
        .select(F.col("source").alias("cut_source"), "source_size", "target", "whole", "p", "q_cut")
    )


def _copies(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    joined = sized.join(small(cut(cuts)), F.col("mix_source").eqNullSafe(F.col("cut_source")))
    more = F.when(F.coalesce(_q() <= F.col("q_cut"), F.lit(False)), 1).otherwise(0)
    return joined.withColumn("copies", F.when(F.col("mix_size") > 0, F.col("whole") + more).otherwise(0).cast("long"))


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, seed: int = 17, weights=WEIGHTS, max_copies: int = MAX_COPIES, bins: int = BINS) -> DataFrame:
    """How many words the mix takes of each document.

    Returns id_col, size, source_size, target, copies, taken = copies * size, one
    row per input row.  weight_col multiplies a document's inclusion odds (null
    or not positive: 1).  Null and empty texts have size 0 and are never taken;
    a null source is a source of its own, the last.  Rows with one id share one
    random number, so repeated rows are taken together or not at all.  An empty
    table gives an empty result.  Other columns are ignored, whatever their names.
    """
    sized = cut(with_sizes(docs, id_col, text_col, source_col, weight_col, seed, []))
    mixed = _copies(sized, source_cuts(sized, weights, max_copies, bins))
    return mixed.select(F.col("mix_id").alias(id_col), F.col("mix_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("mix_size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, seed: int = 17, weights=WEIGHTS, max_copies: int = MAX_COPIES, bins: int = BINS) -> DataFrame:
    """The mixed collection itself: each row of docs as often as the mix takes it.

    Texts stay where they are: what is joined to them has one row per source.
    """
    keep = docs.select(*[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(docs.columns)], F.col(id_col).alias("k_id"), F.col(text_col).alias("k_text"), F.col(source_col).alias("k_source"), *([F.col(weight_col).alias("k_weight")] if weight_col else []))
    kept = [f"keep_{i}" for i in range(len(docs.columns))]
    args = ("k_id", "k_text", "k_source", "k_weight" if weight_col else None, seed)
    cuts = source_cuts(cut(with_sizes(keep, *args, [])), weights, max_copies, bins)
    times = _copies(with_sizes(keep, *args, kept), cuts).where("copies > 0")
    rows = times.select(*kept, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.select(*[F.col(k).alias(c) for k, c in zip(kept, docs.columns, strict=True)])
