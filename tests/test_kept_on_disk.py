"""Tables of cells are kept as Parquet, and exports are passed on without writing all that is known again."""

import os

import pytest
from graphspan import plans
from graphspan.operators.graph import Stored

FOLDER = "/root/testdata/sf0.001"


def checkpoints(spark) -> set[str]:
    return {f for f in os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if f.startswith("rdd-")}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_a_step_of_training_writes_few_checkpoints(spark):
    Stored(spark, "test").drop()  # sets the folder
    before = checkpoints(spark)
    plans.QUERIES["embedding_step"](spark, FOLDER)
    assert len(checkpoints(spark) - before) <= 3  # a row for each document, one for each word, and one that sets the folder; words by document and cells were others
