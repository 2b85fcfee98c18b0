"""Modules are parsed by all tasks, and types that come again are read once."""

import os

import pytest
from graphspan.operators import lattice
from graphspan.plans import syntax
from graphspan.sources.tables import Tables
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_modules_are_dealt_to_all_parts(spark):
    rows = syntax.order_modules(Tables(spark, FOLDER))
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_folds_that_come_again_are_remembered():
    lattice.met_text.cache_clear()
    texts = ("{A: F1}", None, "{A: F0, N: any}")
    want = lattice.to_text(lattice.meet_all(lattice.from_text(t or "any") for t in texts))
    assert [lattice.met_text(texts) for _ in range(3)] == [want] * 3
    assert lattice.met_text.cache_info().hits == 2


def test_projects_are_dealt_to_all_parts(spark):
    from graphspan.sources.projects import parse_projects

    files = spark.createDataFrame([(f"p{i}", "a.json", '{"name": "a.ts", "stmts": []}') for i in range(200)], "project string, path string, text string")
    rows = parse_projects(files).where("kind = 'Project'")
    assert rows.count() == 200
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
