"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only if a count has shown that it has no more rows than this.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, made the checkpoint folder if none is set yet.

    Where that setting is missing a temporary folder takes its place, but only
    with a local master: on a cluster executors would not see it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphspan-"))
    return context.getCheckpointDir()


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether Spark's file system has the folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this code has written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sealed(df: DataFrame) -> DataFrame:
    """df with its columns called k0, k1, ..: no name of the caller's can clash with a helper column."""
    return df.toDF(*[f"k{i}" for i in range(len(df.columns))])


def cut(df: DataFrame) -> DataFrame:
    """The rows of df behind a reliable checkpoint, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sweep(spark: SparkSession) -> None:
    """Lets go of shuffle and checkpoint files that nothing refers to any more.

    Spark deletes them when the driver collects its garbage, which a driver with
    little to do may not do for hours; loops leave many of them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else df as it is.

    Counting runs df, so it should be cheap or behind `cut`.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remainder(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % parts


def unit(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on nothing but the key as text and the seed."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


#: Bits of a bitmap of keys.
CELLS = 1 << 20


def likely_in(keys: DataFrame, key: str):
    """A test, column -> boolean column, that is true for every value of keys[key] and
    false for most others while there are fewer of them than CELLS.

    The bitmap is a constant of CELLS bits in the plan, whatever the number of keys.
    """
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(CELLS)).cast("int")
    place = cell(F.col(key).cast("bigint"))
    words = keys.select((place / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place % 64).alias("bit")).groupBy("w").agg(F.bit_or("bit"))
    bits = [0] * (CELLS // 64)
    for w, b in words.collect():  # CELLS / 64 rows at most
        bits[w] = b
    marks = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")
    return lambda c: F.getbit(F.get(marks, (cell(c.cast("bigint")) / 64).cast("int")), cell(c.cast("bigint")) % 64) == 1
