"""What a module says by itself is what the joins over rows of modules say, without a shuffle or a checkpoint."""

import json
import os

import pytest
from graphspan import plans
from graphspan.operators import lowering, resolution, syntax_text
from graphspan.operators.in_module import Module, each_module
from graphspan.sources import program

FOLDER = "/root/testdata/sf0.001"
MISSING = "missing"


def tvar(name):
    return {"category": "TVar", "name": name}


def user(name):
    return {"category": "UserAnnot", "ty": tvar(name)}


def var(name):
    return {"category": "Var", "name": name, "mark": MISSING}


def const(value, ty="number"):
    return {"category": "Const", "ty": tvar(ty), "value": value, "line": 1, "mark": MISSING}


def call(f, *args):
    return {"category": "FuncCall", "mark": MISSING, "f": f, "args": list(args)}


def access(e, field):
    return {"category": "Access", "expr": e, "field": field, "mark": MISSING}


def obj(**fields):
    return {"category": "ObjLiteral", "mark": MISSING, "fields": [{"name": k, "value": v} for k, v in fields.items()]}


def block(*stmts):
    return {"category": "BlockStmt", "stmts": list(stmts)}


def let(name, init=None, mark=MISSING, **more):
    return {"category": "VarDef", "x": name, "mark": mark, "init": init, "isConst": False, "modifiers": []} | more


def func(name, args, body, result=MISSING, **more):
    return {"category": "FuncDef", "name": name, "tyVars": [], "args": [{"name": a, "value": [m, None]} for a, m in args], "returnType": [result, None], "body": body, "modifiers": []} | more


def returned(e, is_return=True):
    return {"category": "ExprStmt", "isReturn": is_return, "expr": e}


def when(cond, a, b):
    return {"category": "IfStmt", "cond": cond, "branch1": a, "branch2": b}


CLASS = {
    "category": "ClassDef", "name": "Point", "superTypes": ["Base", "number", "T"], "tyVars": ["U"], "modifiers": ["export", "default"], "instanceLambdas": [], "staticLambdas": [],
    "constr": func("Constructor", [("y", user("U"))], block(let("tmp", var("y"))), publicVars=["y"]),
    "vars": [{"name": "x", "value": [user("number"), const("1"), False, [[3, 0], [3, 4]]]}, {"name": "zero", "value": [{"category": "Inferred", "ty": tvar("U")}, None, True, None]}],
    "funcDefs": [[func("norm", [("k", MISSING)], returned(access(var("this"), "x"))), False], [func("make", [], block()), True]],
}
MANY = {
    "name": "a/many.ts",
    "stmts": [
        {"category": "ImportSingle", "oldName": "a", "newName": "a", "path": "./x"}, {"category": "ImportSingle", "oldName": "a", "newName": "b", "path": "./x"},
        {"category": "ImportDefault", "newName": "d", "path": "lib"}, {"category": "ImportModule", "newName": "all", "path": "lib"}, {"category": "CommentStmt", "text": "note"},
        let("p", obj(x=const("1"), y=obj(), a=var("b")), isConst=True, modifiers=["export"]), let("q", mark=user("string")), let("q", var("q")), let("r", var("q")),
        func("f", [("n", user("number")), ("m", MISSING)], block(
            let("n", var("m")), when(call(var("g"), var("n"), const("s", "string"), call(var("f"))), returned(access(var("p"), "x")), block()),
            {"category": "WhileStmt", "cond": access(var("n"), "go"), "body": block({"category": "AssignStmt", "lhs": access(var("q"), "z"), "rhs": {"category": "Cast", "expr": var("m"), "ty": tvar("string"), "mark": MISSING}})},
            when(var("m"), block(), block(returned(call(access(var("p"), "go")), False), when(const("x", "Odd"), block(let("w")), block()))), func("inner", [("n", MISSING)], returned(var("n"))),
            returned({"category": "IfExpr", "cond": var("n"), "e1": const("2"), "e2": {"category": "Cast", "expr": var("Point"), "ty": tvar("Mine"), "mark": MISSING}, "mark": MISSING}),
        ), user("number"), modifiers=["export", "default"]),
        {"category": "TypeAliasStmt", "name": "T", "tyVars": [], "type": tvar("number"), "superTypes": ["Base", "string"], "modifiers": ["export"]},
        {"category": "NamespaceStmt", "name": "N", "block": block(let("z", const("3"), modifiers=["export"])), "modifiers": ["export"]}, {"category": "NamespaceAliasStmt", "name": "M", "rhs": "N.O"}, CLASS,
        {"category": "ExportSingle", "oldName": "q", "newName": "r", "modifiers": []}, {"category": "ExportSingle", "oldName": "N", "newName": "N", "modifiers": []}, {"category": "ExportDefault", "newName": "p", "modifiers": []},
        {"category": "ExportModule", "from": "./y", "modifiers": []}, {"category": "ExportSingle", "oldName": "u", "newName": "v", "from": "../y", "modifiers": []}, {"category": "ExportDefault", "newName": None, "from": "z", "modifiers": []},
    ],
}
TEXTS = [("p", json.dumps(MANY)), ("q", json.dumps(MANY | {"name": "m.ts"})), ("p", '{"name": "empty.ts", "stmts": []}'), ("p", "no module"), ("p", None), ("p", '{"name": "x.ts", "stmts": [{"category": "Odd"}]}')]


def compare(spark, found, schema, want):
    """What each module gives, and what joins over the rows of modules give."""
    texts = spark.createDataFrame(TEXTS, "project string, json string")
    got = each_module(texts, found, schema)
    want = want(program.parse_modules(texts).cache())
    order = lambda df: sorted((tuple(r) for r in df.select(*want.columns).collect()), key=repr)
    assert order(got) == order(want) and order(want)


TOKENS = "pos int, token string, keyword boolean, node string, target string"


def test_tokens_of_a_module(spark):
    compare(spark, Module.tokens, TOKENS, lambda rows: syntax_text.token_stream(rows, resolution.resolve_names(rows)))


def test_names_of_a_module(spark):
    compare(spark, Module.names, "id int, name string, slot string, target string", resolution.resolve_names)


def test_text_of_a_module(spark):
    compare(spark, Module.text, "text string", syntax_text.source_text)


def lowered(rows):
    return resolution.lower_statements(rows, resolution.resolve_names(rows))


def test_relations_of_a_module(spark):
    texts = spark.createDataFrame(TEXTS, "project string, json string")
    got = each_module(texts, Module.relations, "lhs string, rhs string, category string").select("lhs", "rhs", "category").distinct()
    assert sorted(got.collect()) == sorted(lowering.relations(lowered(program.parse_modules(texts))).collect()) and not got.isEmpty()


def test_definitions_of_a_module(spark):
    compare(spark, Module.definitions, "node string, define string, pos int, label string, arg string", lambda rows: lowering.definitions(lowered(rows)))


def test_exports_and_links_of_a_module(spark):
    compare(spark, Module.exports, "symbol string, slot string, node string", resolution.collect_exports)
    path = resolution.resolved_path(resolution.F.col("module"), resolution.F.col("path"))
    texts = spark.createDataFrame(TEXTS, "project string, json string")
    got = each_module(texts, Module.links, "path string, old string, new string").select("project", "module", path.alias("from_module"), "old", "new")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, resolution.export_links(program.parse_modules(texts)).collect()))


def test_a_better_export_is_passed_on_again(spark):
    # n gets x through * first, then by name from farther away, and what it passed on is bettered
    own = spark.createDataFrame([("p", m, "x", "term", f"{m}#1") for m in "abz"] + [("p", "z", "default", "term", "z#2")], "project string, module string, symbol string, slot string, node string")
    links = spark.createDataFrame(
        [("p", "n", "z", "*", "*"), ("p", "k", "b", "x", "y"), ("p", "n", "k", "y", "x"), ("p", "t", "n", "*", "*"), ("p", "n", "t", "*", "*"), ("p", "a", "n", "*", "*"), ("p", "o", "z", "default", None)],
        "project string, module string, from_module string, old string, new string",
    )
    got = {(r.module, r.symbol): r.node for r in resolution.passed_on(own, links).collect()}
    assert got == {("a", "x"): "a#1", ("b", "x"): "b#1", ("z", "x"): "z#1", ("z", "default"): "z#2", ("k", "y"): "b#1", ("n", "x"): "b#1", ("t", "x"): "b#1", ("o", None): "z#2"}
    before = checkpoints(spark)
    resolution.passed_on(own, links)
    assert len(checkpoints(spark) - before) <= 1  # it was one for each round


def checkpoints(spark):
    return {f for f in os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if f.startswith("rdd-")}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize(("name", "shuffles"), [("token_stream", 4), ("resolve_names", 4), ("module_text", 4), ("lowered_definitions", 4), ("lower_statements", 5)])
def test_syntax_is_not_shuffled(spark, name, shuffles):
    # orders, lines, and orders with their numbers of lines: rows of syntax go nowhere
    plan = plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= shuffles and "ExistingRDD" not in plan and "MapInArrow" in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_modules_are_parsed_by_all_tasks(spark):
    made = plans.QUERIES["module_text"](spark, FOLDER)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
