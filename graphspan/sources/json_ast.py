"""Ingest of parsed modules given as JSON, and lenient JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lenient(json: Column) -> Column:
    """JSON text without trailing commas before a closing bracket."""
    return F.regexp_replace(json, r",(\s*[\]}])", "$1")


def modules(spark: SparkSession, path: str) -> DataFrame:
    """Modules of files with {path, is_decl, stmts} per line; statements of one path are joined."""
    rows = spark.read.text(path, wholetext=False).select(F.from_json(lenient(F.col("value")), "path string, is_decl boolean, stmts array<string>").alias("m")).select("m.*")
    return rows.groupBy("is_decl", "path").agg(F.flatten(F.collect_list("stmts")).alias("stmts"))


def source_files(spark: SparkSession, root: str, pattern: str = "*.ts", skip: tuple[str, ...] = ("node_modules",)) -> DataFrame:
    """path, text, is_decl, loc of the source files under root, without files below a skipped folder."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    files = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in skip])))
    return files.withColumn("is_decl", F.endswith("path", F.lit(".d.ts"))).withColumn("loc", F.size(F.split("text", "\n")))


def package_info(json: Column) -> tuple[Column, Column]:
    """Name and development dependencies of a package file."""
    return F.get_json_object(json, "$.name"), F.json_object_keys(F.get_json_object(json, "$.devDependencies"))


def remove_extension(path: Column) -> Column:
    """The path without the first of .d.ts, .js, .ts, .d at its end."""
    return F.regexp_replace(path, r"(\.d\.ts|\.js|\.ts|\.d)$", "")
