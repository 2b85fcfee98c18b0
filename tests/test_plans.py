"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest
from graphspan import plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(FOLDER):
        connection.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return connection


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, duck, name):
    got, want = plans.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(plans.SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_others_run(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["anneal_search", "ce_search"])
def test_searches_assign_every_customer(spark, name):
    got = plans.QUERIES[name](spark, FOLDER).toPandas()
    customers = spark.read.parquet(f"{FOLDER}/customer.parquet").toPandas()
    assert sorted(got["node"]) == sorted(customers["c_custkey"])
    assert got["project"].nunique() == len(customers[["c_mktsegment", "c_nationkey"]].drop_duplicates())


def test_search_proposals_follow_order_lines(spark):
    from graphspan.plans.datasets import _search_input
    from graphspan.sources.tables import Tables

    got = _search_input(Tables(spark, FOLDER))[0].toPandas()
    orders, lines = (spark.read.parquet(f"{FOLDER}/{x}.parquet").toPandas() for x in ("orders", "lineitem"))
    q = lines.merge(orders, left_on="l_orderkey", right_on="o_orderkey").groupby(["o_custkey", "l_returnflag"])["l_quantity"].sum().to_dict()
    for node, g in got.groupby("node"):
        want = {x: 1 + q.get((node, x), 0) for x in "ANR"}
        assert {k: round(p, 9) for k, p in zip(g["type_id"], g["prob"], strict=True)} == {x: round(y / sum(want.values()), 9) for x, y in want.items()}
