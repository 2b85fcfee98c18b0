"""Rows that share most segments, by sets of segments."""

import random

from graphspan.plans.names import most_shared
from pyspark.sql import functions as F


def test_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, sorted(rng.sample("abcdef", rng.randint(0, 3)))) for i in range(120)]
    got = sorted(map(tuple, most_shared(spark.createDataFrame(rows, "k bigint, s array<string>"), "k", "s", F.col("id") % 10 == 0, 5).collect()))
    want = []
    for i, s in rows[::10]:
        pairs = sorted((-len({*s} & {*x}), j) for j, x in rows if j != i and {*s} & {*x})[:5]
        want += [(i, j, -n, r + 1) for r, (n, j) in enumerate(pairs)]
    assert got == sorted(want)


def test_equal_sets_meet_once(spark):
    # all pairs of these would be 25 000 000
    rows = spark.range(5000).select("id", F.array(F.lit("a"), F.lit("b")).alias("s"))
    made = most_shared(rows, "id", "s", F.lit(True), 5)
    assert made.count() == 25_000
    assert {r["other"] for r in made.collect()} == set(range(6))
