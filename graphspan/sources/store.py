"""Writing and reading datasets, parameters, results and event logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMS_SCHEMA = "path string, shape array<int>, data array<double>, regularize boolean"
EVENT_SCHEMA = "name string, iteration bigint, value double"


def write_splits(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """A dataset by its column split; readers of one split read no other."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at path, in any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def read_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; made and written first if there is none."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_params(spark: SparkSession, path: str, params: dict[str, tuple[list[int], list[float], bool]]) -> None:
    spark.createDataFrame([(k, *v) for k, v in sorted(params.items())], PARAMS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> dict[str, tuple[list[int], list[float], bool]]:
    return {r.path: (r.shape, r.data, r.regularize) for r in spark.read.schema(PARAMS_SCHEMA).parquet(path).collect()}


def append_events(events: DataFrame, path: str) -> None:
    """Appends (name, iteration, value) rows to a log."""
    events.select("name", F.col("iteration").cast("bigint"), F.col("value").cast("double")).write.mode("append").parquet(path)


def event_lines(events: DataFrame) -> DataFrame:
    """The log as text, one list literal for each event."""
    return events.select(F.format_string('{"%s", %d, %s}', "name", "iteration", F.col("value").cast("string")).alias("value"))
