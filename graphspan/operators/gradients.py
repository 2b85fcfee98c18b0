"""Gradients as sparse rows, and parameters as tables that are updated by a join.

A gradient is a table of (param, row, col, value): what is absent is zero, so the
gradient of a few rows of a large table costs these rows only.  Gradients are put
together by union and one sum, combined before the shuffle.  Parameters have the
same columns, so a model larger than a driver or a task can be trained.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import checkpointed, shuffled

KEY = ["param", "row", "col"]
SCHEMA = "param string, row bigint, col int, value double"


def zero_gradient(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def cells(rows: DataFrame, param: str | Column, row: str, vector: str) -> DataFrame:
    """The gradient whose rows are given as vectors."""
    name = F.lit(param) if isinstance(param, str) else param
    return rows.select(name.alias("param"), F.col(row).cast("bigint").alias("row"), F.posexplode(vector).alias("col", "value")).select(*KEY, "value")


def accumulate(*gradients: DataFrame) -> DataFrame:
    """The sum of gradients; cells that add up to nothing go."""
    together = reduce(DataFrame.unionByName, gradients)
    return together.groupBy(*KEY).agg(F.sum("value").alias("value")).where("value <> 0")


def scaled(gradient: DataFrame, factor: float | Column) -> DataFrame:
    return gradient.withColumn("value", F.col("value") * factor)


def inflated(core: DataFrame, row: int, col: int) -> DataFrame:
    """A core put into a larger tensor from (row, col) on: nothing but its numbers change."""
    return core.withColumns({"row": F.col("row") + row, "col": (F.col("col") + col).cast("int")})


def core_of(gradient: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The cells from rows[0] to before rows[1], and so for cols, numbered from 0: the inverse of `inflated`."""
    inside = gradient.where((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))
    return inflated(inside, -rows[0], -cols[0])


def split_rows(gradient: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """The rows before `at`, and the others numbered from 0."""
    return gradient.where(F.col("row") < at), inflated(gradient.where(F.col("row") >= at), -at, 0)


def split_columns(gradient: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    return gradient.where(F.col("col") < at), inflated(gradient.where(F.col("col") >= at), 0, -at)


def transposed(gradient: DataFrame) -> DataFrame:
    return gradient.select("param", F.col("col").cast("bigint").alias("row"), F.col("row").cast("int").alias("col"), "value")


def unbroadcast(gradient: DataFrame, axis: int) -> DataFrame:
    """The gradient of what was repeated along an axis: the sum along it."""
    return gradient.withColumn("row" if axis == 0 else "col", F.lit(0).cast("bigint" if axis == 0 else "int")).groupBy(*KEY).agg(F.sum("value").alias("value"))


def clipped(gradient: DataFrame, least: float, most: float) -> DataFrame:
    """Each cell within [least, most]; absent cells are zero, so that the interval has to hold it."""
    if least > 0 or most < 0:
        raise ValueError("the interval must hold zero, absent cells stay absent")
    return gradient.withColumn("value", F.greatest(F.lit(least), F.least(F.lit(most), F.col("value"))))


def clip_norm(gradient: DataFrame, most: float) -> DataFrame:
    """Each parameter's gradient scaled down to the norm `most` if it is longer.  Cells of a parameter are summed where they lie."""
    norms = gradient.groupBy(F.col("param").alias("_p")).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    factor = F.when(F.col("_norm") > most, F.lit(most) / F.col("_norm")).otherwise(1.0)
    return gradient.join(F.broadcast(norms), F.col("param") == F.col("_p")).select(*KEY, (F.col("value") * factor).alias("value"))  # a row for each parameter of the model


def dense(gradient: DataFrame, shapes: DataFrame) -> DataFrame:
    """All cells of shapes(param, rows, cols), zeros included."""
    grid = shapes.select(F.col("param").alias("_p"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("_r"), "cols").select("_p", "_r", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("_c"))
    met = grid.join(gradient, (F.col("_p") == F.col("param")) & (F.col("_r") == F.col("row")) & (F.col("_c") == F.col("col")), "left")
    return met.select(F.col("_p").alias("param"), F.col("_r").cast("bigint").alias("row"), F.col("_c").cast("int").alias("col"), F.coalesce("value", F.lit(0.0)).alias("value"))


def sgd(parameters: DataFrame, gradient: DataFrame, rate: float, decay: float = 0.0, decayed: list[str] | None = None) -> DataFrame:
    """parameters after a step down the gradient; parameters named in `decayed` also lose rate * decay of their values.

    Cells without a gradient keep their values.
    """
    step = gradient.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("value").alias("_g"))
    met = parameters.join(step, [F.col(c) == F.col(f"_{c}") for c in KEY], "left")
    shrunk = F.when(F.col("param").isin(decayed or []), F.col("value") * (1 - rate * decay)).otherwise(F.col("value"))
    return met.select(*KEY, (shrunk - rate * F.coalesce("_g", F.lit(0.0))).alias("value"))


def adam(parameters: DataFrame, moments: DataFrame | None, gradient: DataFrame, rate: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """(parameters, moments) after a bias-corrected step at the cells that have a gradient.

    moments(param, row, col, t, m, v) are kept sparsely: cells that never had a
    gradient have none, and a cell's step number counts its own gradients.
    """
    step = gradient.select(*KEY, F.col("value").alias("g"))
    if moments is None:
        moments = step.select(*KEY, F.lit(0).cast("bigint").alias("t"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v")).limit(0)
    met = moments.join(step, KEY, "full").select(*KEY, "g", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("t", "m", "v")])
    moved = F.col("g").isNotNull()
    new = met.select(*KEY, "g", (F.col("t") + moved.cast("bigint")).alias("t"), F.when(moved, F.col("m") * b1 + F.col("g") * (1 - b1)).otherwise(F.col("m")).alias("m"), F.when(moved, F.col("v") * b2 + F.col("g") * F.col("g") * (1 - b2)).otherwise(F.col("v")).alias("v"))
    new = checkpointed(new)
    change = (F.col("m") / (1 - F.pow(F.lit(b1), F.col("t")))) / (F.sqrt(F.col("v") / (1 - F.pow(F.lit(b2), F.col("t")))) + eps)
    moves = new.where("g IS NOT NULL").select(*KEY, change.alias("value"))
    return sgd(parameters, moves, rate), new.drop("g")


def mean_of_rows(rows: DataFrame, key: str, row: str, times: str, parameters: DataFrame, param: str, out: str) -> DataFrame:
    """key, col, out: the mean of a parameter's rows over the entries(key, row, times) of a key, cell by cell."""
    table = parameters.where(F.col("param") == param).select(F.col("row").alias("_r"), "col", "value")
    met = rows.join(table, F.col(row) == F.col("_r"))
    return met.groupBy(key, "col").agg((F.sum(F.col("value") * F.col(times)) / F.sum(times)).alias(out))


def logistic_bag_gradient(entries: DataFrame, key: str, row: str, times: str, truth: DataFrame, parameters: DataFrame, table: str, weights: str) -> tuple[DataFrame, DataFrame]:
    """(gradient, losses): of the mean log loss of truth(key, y) under sigmoid(mean of table rows . weights).

    The gradient has the rows of the table that occur, and the weights (row 0).
    losses(key, p, loss): a row for each key.  A mean's product with the weights is the mean of its
    rows' products, and the weights' gradient is the table times what each of its rows gets, so
    entries only ever meet one number for each row or key, whatever the size of a row.
    """
    w = parameters.where(F.col("param") == weights).select(F.col("col").alias("_c"), F.col("value").alias("w"))
    rows = parameters.where(F.col("param") == table).select(F.col("row").alias("_r"), "col", "value")
    products = rows.join(F.broadcast(w), F.col("col") == F.col("_c")).groupBy("_r").agg(F.sum(F.col("value") * F.col("w")).alias("_s"))  # weights: a row for each element
    # an entry whose row the table lacks has no part in the mean
    met = entries.join(shuffled(products), F.col(row) == F.col("_r"), "left")
    scored = met.groupBy(key).agg((F.sum(F.col("_s") * F.col(times)) / F.sum(F.when(F.col("_s").isNotNull(), F.col(times)))).alias("z"), F.sum(times).alias("_n")).where("z IS NOT NULL")
    p = 1 / (1 + F.exp(-F.col("z")))
    out = checkpointed(scored.join(truth, key).select(key, p.alias("p"), "y", (p - F.col("y")).alias("e"), -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p)), "_n"))
    out = out.toDF(key, "p", "y", "e", "loss", "_n")
    n = out.count()
    share = entries.join(shuffled(out.select(F.col(key).alias("_o"), "e", "_n")), F.col(key) == F.col("_o"))
    of_row = checkpointed(share.groupBy(row).agg(F.sum(F.col("e") * F.col(times) / F.col("_n") / n).alias("s")))  # one number for each row, then times the weights
    of_table = of_row.select(F.lit(table).alias("param"), F.col(row).cast("bigint").alias("row"), "s").join(F.broadcast(w)).select("param", "row", F.col("_c").alias("col"), (F.col("s") * F.col("w")).alias("value"))
    of_weights = rows.join(shuffled(of_row), F.col("_r") == F.col(row)).groupBy("col").agg(F.sum(F.col("value") * F.col("s")).alias("value"))
    of_weights = of_weights.select(F.lit(weights).alias("param"), F.lit(0).cast("bigint").alias("row"), "col", "value")
    # each row and element comes once, so two parameters have no cells to add up
    found = accumulate(of_table, of_weights) if table == weights else of_table.unionByName(of_weights).where("value <> 0")
    return found, out.select(key, "p", "loss")
