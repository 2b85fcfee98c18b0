"""Syntax trees, scopes, lowering, links between modules, and the lattice of types."""

import json
import random

import pytest
from graphspan.operators import lattice, lowering, resolution
from graphspan.operators.types import ast_sizes
from graphspan.sources import program

MISSING = "missing"
SPAN = [[1, 0], [1, 5]]


def var(name):
    return {"category": "Var", "name": name, "mark": MISSING}


def tvar(name):
    return {"category": "TVar", "name": name}


def returned(e):
    return {"category": "ExprStmt", "isReturn": True, "expr": e}


def func(name, args, body, **more):
    return {"category": "FuncDef", "name": name, "tyVars": [], "args": [{"name": a, "value": [MISSING, SPAN]} for a in args], "returnType": [MISSING, None], "body": body, "modifiers": []} | more


def block(*stmts):
    return {"category": "BlockStmt", "stmts": list(stmts)}


def let(name, init=None, **more):
    return {"category": "VarDef", "x": name, "mark": MISSING, "init": init, "isConst": False, "modifiers": []} | more


POINT = {
    "category": "ClassDef", "name": "Point", "superTypes": ["Base"], "tyVars": ["T"], "modifiers": ["export"],
    "vars": [{"name": "x", "value": [{"category": "UserAnnot", "ty": tvar("number")}, {"category": "Const", "ty": tvar("number"), "value": "1", "line": 1, "mark": MISSING}, False, SPAN]},
             {"name": "zero", "value": [{"category": "Inferred", "ty": tvar("T")}, None, True, SPAN]}],
    "constr": func("Constructor", ["y"], block(let("tmp", var("y"))), publicVars=["y"]),
    "funcDefs": [[func("norm", ["k"], returned({"category": "Access", "expr": var("this"), "field": "x", "mark": MISSING})), False], [func("make", [], block()), True]],
    "instanceLambdas": [], "staticLambdas": [],
}


def parsed(spark, *modules, project="p"):
    return program.parse_modules(spark.createDataFrame([(project, m if isinstance(m, str | None) else json.dumps(m)) for m in modules], "project string, json string"))


def test_lenient_json():
    text = """{ // a comment, with ] and }
      'name': "a/b.ts", /* , ] */ "stmts": ["it's", 'say "hi", it\\'s', [1, 2, ], {"u": "http://x, ]",}, ], }"""
    assert program.read_lenient(text) == {"name": "a/b.ts", "stmts": ["it's", 'say "hi", it\'s', [1, 2], {"u": "http://x, ]"}]}


def test_a_class_becomes_a_namespace_and_members(spark):
    rows = parsed(spark, {"name": "m.ts", "stmts": [POINT]}).toPandas().sort_values("id")
    at = lambda **want: rows[(rows[list(want)] == list(want.values())).all(axis=1)]
    space, cls = at(kind="Namespace").iloc[0], at(kind="Class").iloc[0]
    assert (space["name"], space["exported"], cls["value"]) == ("Point", "public", "Base")
    assert list(at(kind="Field")["name"]) == ["x", "y"]
    assert list(at(kind="FuncDef")["name"]) == ["CONSTRUCTOR", "make", "norm"]
    fixed = at(kind="Result", mark="fixed").iloc[0]
    assert fixed["type"] == "Point"
    static = at(kind="VarDef", name="zero").iloc[0]
    assert static["type"] == "T" and static["is_const"]
    # the constructor: this and super, then fields, then its own statements
    body = rows[(rows["parent"] == at(kind="FuncDef", name="CONSTRUCTOR").iloc[0]["id"] + 1) & (rows["role"] == "stmt")]
    assert list(body["kind"]) == ["VarDef", "VarDef", "Assign", "Assign", "VarDef"] and list(body["name"].dropna()) == ["this", "super", "tmp"]


def test_abstract_classes_have_no_constructor(spark):
    rows = parsed(spark, {"name": "m.ts", "stmts": [POINT | {"modifiers": ["abstract"], "constr": None}]}).toPandas()
    assert "CONSTRUCTOR" not in set(rows["name"]) and set(rows[rows["kind"] == "Field"]["name"]) == {"x"}


def test_interfaces_of_one_name_are_merged(spark):
    alias = lambda fields, supers=(): {"category": "TypeAliasStmt", "name": "I", "tyVars": [], "modifiers": [], "superTypes": list(supers), "type": {"category": "ObjectType", "fields": [{"name": k, "value": tvar(v)} for k, v in fields.items()]}}
    rows = parsed(spark, {"name": "m.d.ts", "stmts": [alias({"a": "x", "b": "y"}, ["S"]), let("v"), alias({"b": "z", "c": "w"}, ["T"])]}).where("kind = 'TypeAlias'").collect()
    assert [(r["type"], r["value"]) for r in rows] == [("{a: x, b: any, c: w}", "S,T")]


def test_odd_modules(spark):
    rows = parsed(spark, None, "not json", {"name": "e.ts", "stmts": []}, {"name": "u.ts", "stmts": [{"category": "Nothing"}]}).toPandas()
    assert sorted(rows["kind"]) == ["Error", "Error", "Module"] and rows[rows["kind"] == "Module"].iloc[0]["module"] == "e"
    assert parsed(spark).count() == 0


def test_every_statement_and_expression(spark):
    e = {"category": "IfExpr", "cond": var("c"), "e1": var("a"), "e2": {"category": "Cast", "expr": var("b"), "ty": tvar("number"), "mark": MISSING}, "mark": MISSING}
    stmts = [
        func("f", ["a", "b", "c"], block(
            {"category": "IfStmt", "cond": var("c"), "branch1": block(returned(e)), "branch2": block({"category": "AssignStmt", "lhs": {"category": "Access", "expr": var("a"), "field": "q", "mark": MISSING}, "rhs": var("b")})},
            {"category": "WhileStmt", "cond": var("a"), "body": block(let("a", {"category": "ObjLiteral", "fields": [{"name": "k", "value": var("a")}], "mark": MISSING}), {"category": "ExprStmt", "isReturn": False, "expr": var("a")})},
            {"category": "CommentStmt", "text": "hi"}), modifiers=["async"]),
        {"category": "NamespaceStmt", "name": "ns", "block": block(let("inner")), "modifiers": []},
        {"category": "NamespaceAliasStmt", "name": "q", "rhs": "a.b"},
    ]
    rows = parsed(spark, {"name": "m.tsx", "stmts": stmts})
    assert rows.where("kind = 'FuncDef'").first()["name"] == "$Async_f"
    resolved = resolution.resolve_names(rows)
    flat = resolution.lower_statements(rows, resolved).toPandas()
    by = {k: g.sort_values("id") for k, g in flat.groupby("kind")}
    args = {r["name"]: f"m#{r['id']}" for r in rows.where("kind = 'Arg'").collect()}
    cond = by["IfExpr"].iloc[0]
    assert (cond["cond"], cond["rhs"]) == (args["c"], args["a"]) and cond["rhs2"] == by["Cast"].iloc[0]["v"]
    assert (by["Cast"].iloc[0]["rhs"], by["Cast"].iloc[0]["type_node"]) == (args["b"], "lib:Number")
    assert by["Return"].iloc[0]["v"] == f"m#{rows.where(chr(107) + 'ind = ' + repr('Result')).first()['id']}"
    assert by["Assign"].iloc[0]["v"] == by["Access"].iloc[0]["v"] and by["Assign"].iloc[0]["rhs"] == args["b"]
    # inside the loop a is the inner one, in the condition the argument
    inner = by["VarDef"].iloc[0]["v"]
    assert by["While"].iloc[0]["cond"] == args["a"] and by["Object"].iloc[0]["args"][0]["arg"] == inner
    pairs = {(r["lhs"], r["rhs"], r["category"]) for r in lowering.relations(resolution.lower_statements(rows, resolved)).collect()}
    assert (cond["rhs"], cond["v"], "subtype") in pairs and (by["Cast"].iloc[0]["v"], "lib:Number", "fixType") in pairs


def test_classes_inherit_and_this_is_known(spark):
    rows = parsed(spark, {"name": "m.ts", "stmts": [{"category": "TypeAliasStmt", "name": "Base", "tyVars": [], "modifiers": [], "superTypes": [], "type": {"category": "ObjectType", "fields": []}}, POINT]})
    resolved = resolution.resolve_names(rows)
    flat = resolution.lower_statements(rows, resolved)
    base = rows.where("kind = 'TypeAlias'").first()["id"]
    assert flat.where("kind = 'ClassDef'").first()["rhs"] == f"m#{base}"
    this = {r["id"]: r["target"] for r in resolved.where("name = 'this'").collect()}
    assert this and all(t.startswith("m#") for t in this.values())


def test_export_import_chain(spark):
    """A re-export chain, a default export, an import under another name, a folder, a cycle and an unresolved import."""
    link = lambda kind, **f: {"category": kind, "modifiers": []} | f
    modules = [
        {"name": "a.ts", "stmts": [let("x", modifiers=["export"]), func("main", [], block(), modifiers=["export", "default"]), let("hidden"), link("ExportSingle", oldName="hidden", newName="seen"), link("ExportModule", **{"from": "./dir/c"})]},
        {"name": "dir/b.ts", "stmts": [link("ExportModule", **{"from": "../a"}), link("ExportSingle", oldName="default", newName="start", **{"from": "../a"})]},
        {"name": "dir/c.ts", "stmts": [link("ExportModule", **{"from": "./b"}), let("x", modifiers=["export"])]},
        {"name": "d.ts", "stmts": [link("ImportSingle", oldName="x", newName="y", path="./dir/c"), link("ImportDefault", newName="go", path="./a"), link("ImportModule", newName="whole", path="lib/thing"), link("ImportSingle", oldName="none", newName="gone", path="./a"),
                                   link("ImportSingle", oldName="seen", newName="far", path="./dir/b"), returned({"category": "FuncCall", "f": var("go"), "args": [var("y"), var("gone"), var("other")], "mark": MISSING})]},
    ]
    rows = parsed(spark, *modules)
    exports = resolution.linked_exports(rows)
    got = {(r["module"], r["symbol"]): r["node"] for r in exports.collect()}
    assert got["a", "x"] == "a#1" and got["dir/b", "x"] == "a#1" and got["dir/c", "x"].startswith("dir/c#")  # own ones win
    assert got["a", "default"] == got["a", "main"] == got["dir/b", "start"] and ("dir/b", "default") not in got
    assert got["dir/c", "seen"] == got["a", "seen"] and ("a", "hidden") not in got
    imports = resolution.collect_imports(rows, exports)
    seen = {r["name"]: r["target"] for r in imports.where("module = 'd' AND slot = 'term'").collect()}
    assert seen == {"y": got["dir/c", "x"], "go": got["a", "default"], "whole": "module:lib/thing", "gone": "unknown:a/none", "far": got["a", "seen"]}
    library = spark.createDataFrame([("other", "term", "lib:other")], "name string, slot string, node string")
    uses = {r["name"]: r["target"] for r in resolution.resolve_names(rows, imports, library).where("module = 'd'").collect()}
    assert uses["go"] == got["a", "default"] and uses["y"] == got["dir/c", "x"] and uses["other"] == "lib:other"


def types(n=300, seed=3):
    rng = random.Random(seed)
    return [lattice.random_type(rng, ["A", "B", "int"], rng.randint(1, 25)) for _ in range(n)]


def test_lattice_laws():
    for t, u in zip(types(), types(seed=4), strict=True):
        assert lattice.from_text(lattice.to_text(t)) == t
        assert lattice.meet(t, t) == t and lattice.meet(t, lattice.ANY) == t == lattice.meet(lattice.ANY, t)
        assert lattice.meet(t, u) == lattice.meet(u, t)
        assert lattice.substitute(t, {}) == t and "A" not in lattice.names_of(lattice.monotype(t, {"A"}))
        assert lattice.size_of(t) == 1 + sum(lattice.size_of(x) for _, _, x in lattice.parts(t))
    a, b, c = (("var", x) for x in "ABC")
    assert lattice.meet(lattice.meet(a, b), c) == c and lattice.meet(a, lattice.meet(b, c)) == a  # the order matters
    f = lattice.from_text("(A,{x: B})->C")
    assert lattice.to_text(lattice.meet(f, lattice.from_text("(A)->D"))) == "(A,{x: B})->any"
    assert lattice.labels_of(f) == {"x"} and lattice.names_of(f) == {"A", "B", "C"}
    with pytest.raises(ValueError):
        lattice.merge_objects(lattice.from_text("{a: A}"), lattice.from_text("{a: B}"), overlap=False)


def test_types_as_rows_of_any_depth(spark):
    deep = lattice.ANY
    for i in range(40):
        deep = ("object", (("f", deep),)) if i % 2 else ("func", (deep,), ("var", "A"))
    texts = [lattice.to_text(t) for t in [*types(60), deep]]
    rows = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "type string")
    kinds, children = lattice.hash_consed(rows, "type")
    sizes = {r["type_id"]: r["size"] for r in ast_sizes(kinds, children).collect()}
    assert all(sizes[t] == lattice.size_of(lattice.from_text(t)) for t in texts) and len(sizes) > 100
    found = {r["type_id"]: r["text"] for r in lowering.type_texts(kinds, children).collect()}
    assert all(k == v for k, v in found.items())
    met = rows.select(lattice.meet_text(rows["type"], rows["type"]).alias("m")).collect()
    assert sorted(r["m"] for r in met) == sorted([*texts, texts[0], "any"])
