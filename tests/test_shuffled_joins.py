"""Rows that are parsed or exploded are more than Spark expects: no join sends them through the driver."""

import os

import pytest
from graphspan import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", ["resolve_names", "lower_statements", "lowered_definitions", "module_imports", "module_text", "token_stream"])
def test_syntax_rows_are_not_broadcast(spark, name):
    plan = plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_calls_and_signatures_are_not_broadcast(spark):
    plan = plans.QUERIES["call_bounds"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
