"""Loops keep one copy of each of their tables on disk."""

import os

from graphspan.operators import bounds
from graphspan.operators.graph import Stored


def folder_of(spark) -> str:
    return spark.sparkContext.getCheckpointDir().removeprefix("file:")


def test_stored_again_replaces(spark):
    kept = Stored(spark, "test-stored")
    a = kept.put("t", spark.range(10))
    a = kept.put("t", a.where("id > 4"))
    assert sorted(r["id"] for r in a.collect()) == [5, 6, 7, 8, 9]
    assert len(os.listdir(kept.folder.removeprefix("file:"))) == 1
    kept.drop()
    assert not os.path.exists(kept.folder.removeprefix("file:"))


def test_classes_write_few_checkpoints(spark):
    # a chain of accesses: each round merges what the one before has found
    objects = spark.createDataFrame([(f"o{i}", "x", f"p{i}") for i in range(6)] + [(f"p{i}", "x", f"q{i}") for i in range(6)], "node string, label string, field string")
    accesses = spark.createDataFrame([("r", "o0", "x"), ("s", "r", "x")], "node string, object string, label string")
    equalities = spark.createDataFrame([(f"o{i}", f"o{i + 1}") for i in range(5)], "a string, b string")
    Stored(spark, "test").drop()  # sets the folder
    before = set(os.listdir(folder_of(spark)))
    got = {r["node"]: r["component"] for r in bounds.access_classes(objects, accesses, equalities).collect()}
    assert {got[f"o{i}"] for i in range(6)} == {"o0"} and {got[f"p{i}"] for i in range(6)} | {got["r"]} == {"p0"} and {got[f"q{i}"] for i in range(6)} | {got["s"]} == {"q0"}
    made = set(os.listdir(folder_of(spark))) - before
    assert not [f for f in made if f.startswith("access-classes")]
    assert len([f for f in made if f.startswith("rdd-")]) <= 8  # those of the equalities and the result; it was one for each table of each round
