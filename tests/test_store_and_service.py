import json

from graphspan.operators import layers, lowering
from graphspan.sources import store
from graphspan.streaming.service import serve
from pyspark.sql import functions as F


def test_splits_are_pruned(spark, tmp_path):
    path = str(tmp_path / "data")
    store.write_splits(spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "p long, split string"), path)
    part = store.read_split(spark, path, "train")
    assert sorted(r.p for r in part.collect()) == [1, 3]
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().executedPlan().toString()


def test_read_or_make_makes_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "x")
    assert store.read_or_make(spark, path, make).count() == 3 and store.read_or_make(spark, path, make).count() == 3 and len(calls) == 1


def test_params_and_events(spark, tmp_path):
    params = {"a/w": ([1, 2], [0.5, 1.5], True), "a/b": ([1], [0.0], False)}
    store.save_params(spark, str(tmp_path / "p"), params)
    assert store.load_params(spark, str(tmp_path / "p")) == params
    rows = spark.createDataFrame([("loss", 1, 0.5)], "name string, iteration int, value double")
    store.append_events(rows, str(tmp_path / "e"))
    store.append_events(rows, str(tmp_path / "e"))
    log = spark.read.parquet(str(tmp_path / "e"))
    assert log.count() == 2 and store.event_lines(log).first().value == '{"loss", 1, 0.5}'


def test_service_answers_each_request_once(spark, tmp_path):
    requests, answers, state = (tmp_path / x for x in ("in", "out", "state"))
    requests.mkdir()
    run = lambda: serve(spark, str(requests), "n long", lambda b: b.select("n", (F.col("n") * 2).alias("twice")), str(answers), str(state), once=True).awaitTermination(60)
    (requests / "a.json").write_text(json.dumps({"n": 1}))
    run()
    (requests / "b.json").write_text(json.dumps({"n": 5}))
    run()
    run()
    assert sorted((r.n, r.twice) for r in spark.read.parquet(str(answers)).collect()) == [(1, 2), (5, 10)]


def test_relations_drop_self_loops_and_repeats(spark):
    schema = "kind string, v string, rhs string, rhs2 string, cond string, type_node string, args array<struct<label:string,arg:string>>"
    rows = [
        ("VarDef", "a", "a", None, None, None, None), ("VarDef", "a", "b", None, None, None, None), ("VarDef", "a", "b", None, None, None, None), ("IfExpr", "i", "x", "y", "c", None, None),
        ("While", None, None, None, "w", None, None), ("Cast", "t", "e", None, None, "T", None), ("FuncDef", "f", None, None, None, None, [("0", "p"), ("-1", "r")]), ("Comment", "z", "q", None, None, None, None),
    ]
    s = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in lowering.relations(s).collect()} == {("a", "b", "equal"), ("x", "i", "subtype"), ("y", "i", "subtype"), ("e", "t", "subtype"), ("t", "T", "fixType")}
    assert {r.node for r in lowering.conditions(s).collect()} == {"c", "w"}
    assert {tuple(r) for r in lowering.definitions(s).collect()} == {("f", "func", 0, "0", "p"), ("f", "func", 1, "-1", "r")}


def test_seeded_weights_repeat_and_are_bounded():
    w = layers.seeded_weights("p", 4, 5)
    assert w == layers.seeded_weights("p", 4, 5) != layers.seeded_weights("q", 4, 5)
    assert all(abs(x) <= (6 / 9) ** 0.5 for row in w for x in row)
