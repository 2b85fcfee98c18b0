"""Source text, tokens and nesting of syntax rows with every kind of statement and expression."""

import json

from graphspan.operators import resolution, syntax_text
from graphspan.sources import program

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


def block(*stmts):
    return {"category": "BlockStmt", "stmts": list(stmts)}


def let(name, init=None, mark=MISSING, **more):
    return {"category": "VarDef", "x": name, "mark": mark, "init": init, "isConst": False, "modifiers": []} | more


def func(name, args, body, result=MISSING, **more):
    return {"category": "FuncDef", "name": name, "tyVars": [], "args": [{"name": a, "value": [m, None]} for a, m in args], "returnType": [result, None], "body": body, "modifiers": []} | more


def returned(e):
    return {"category": "ExprStmt", "isReturn": True, "expr": e}


MODULE = {
    "name": "m.ts",
    "stmts": [
        {"category": "ImportSingle", "oldName": "a", "newName": "b", "path": "./x"},
        {"category": "ImportDefault", "newName": "d", "path": "lib"},
        {"category": "ImportModule", "newName": "all", "path": "lib"},
        {"category": "CommentStmt", "text": "note"},
        let("p", {"category": "ObjLiteral", "mark": MISSING, "fields": [{"name": "x", "value": const("1")}, {"name": "y", "value": {"category": "ObjLiteral", "mark": MISSING, "fields": []}}]}, isConst=True, modifiers=["export"]),
        let("q", mark=user("string")),
        func("f", [("n", user("number")), ("m", MISSING)], block(
            {"category": "IfStmt", "cond": call(var("g"), var("n")), "branch1": returned({"category": "Access", "expr": var("p"), "field": "x", "mark": MISSING}), "branch2": block()},
            {"category": "WhileStmt", "cond": var("n"), "body": block({"category": "AssignStmt", "lhs": var("q"), "rhs": {"category": "Cast", "expr": var("m"), "ty": tvar("string"), "mark": MISSING}})},
            {"category": "IfStmt", "cond": var("m"), "branch1": block(), "branch2": block({"category": "ExprStmt", "isReturn": False, "expr": call({"category": "Access", "expr": var("p"), "field": "go", "mark": MISSING})})},
            returned({"category": "IfExpr", "cond": var("n"), "e1": const("2"), "e2": var("m"), "mark": MISSING}),
        ), user("number")),
        {"category": "TypeAliasStmt", "name": "T", "tyVars": [], "type": tvar("number"), "modifiers": []},
        {"category": "NamespaceStmt", "name": "N", "block": block(let("z", const("3"))), "modifiers": []},
        {"category": "ExportSingle", "oldName": "q", "newName": "r", "modifiers": []},
        {"category": "ExportModule", "from": "./y", "modifiers": []},
    ],
}

#: Type aliases stand first, as interfaces of one name are merged there.
TEXT = """type T = number;
import {a as b} from "./x";
import d from "lib";
import * as all from "lib";
/* note */
export const p = {x: 1, y: {}};
let q: string;
function f (n: number, m): number
{
  if (g(n))
  {
    return p.x;
  }
  while (n)
  {
    q = (m as string);
  }
  if (m)
  {
  }
  else
  {
    p.go();
  }
  return (n ? 2 : m);
}
namespace N
{
  let z = 3;
}
export {q as r};
export * from "./y";
"""

TOKENS = """beginModule
beginVarDef const missing beginObject endObject endVarDef beginVarDef const missing beginObject x Number y missing endObject endVarDef beginVarDef const p missing endVarDef
beginVarDef let q endVarDef
beginFuncDef f n m beforeReturn missing beginBlock
beginVarDef const missing beginCall g n endCall endVarDef beginIf missing beginBlock beginVarDef const missing beginAccess p x endAccess endVarDef return missing endBlock beginBlock endBlock endIf
beginWhile n beginBlock beginVarDef const missing beginCast m string endCast endVarDef beginAssign q missing endAssign endBlock endWhile
beginIf m beginBlock endBlock beginBlock beginVarDef const missing beginAccess p go endAccess endVarDef beginVarDef const missing beginCall missing endCall endVarDef endBlock endIf
beginVarDef const missing beginIfExpr n Number m endIfExpr endVarDef return missing endBlock endFuncDef
beginBlock beginVarDef let z Number endVarDef endBlock
endModule""".split()


def rows_of(spark, *modules):
    return program.parse_modules(spark.createDataFrame([("p", json.dumps(m)) for m in modules], "project string, json string"))


def test_source_text_of_every_kind(spark):
    again = MODULE | {"name": "again.ts"}
    got = {r.module: r.text for r in syntax_text.source_text(rows_of(spark, MODULE, again, {"name": "empty.ts", "stmts": []})).collect()}
    assert got == {"m": TEXT, "again": TEXT}


def test_classes_are_written_with_their_members(spark):
    cls = {
        "category": "ClassDef", "name": "Point", "superTypes": ["Base"], "tyVars": [], "modifiers": ["export"], "constr": None, "instanceLambdas": [], "staticLambdas": [],
        "vars": [{"name": "x", "value": [user("number"), None, False, None]}], "funcDefs": [[func("norm", [("k", MISSING)], returned(var("k"))), False]],
    }
    # methods define this and super, as classes are taken apart so
    text = syntax_text.source_text(rows_of(spark, {"name": "c.ts", "stmts": [cls]})).first().text
    assert text.endswith("class Point extends Base {\n  x: number;\n  function norm (k)\n  {\n    const this: Point;\n    const super: Point;\n    return k;\n  }\n}\n")


def test_token_stream_of_every_kind(spark):
    rows = rows_of(spark, MODULE)
    found = syntax_text.token_stream(rows, resolution.resolve_names(rows)).orderBy("pos").collect()
    assert [r.token for r in found] == TOKENS and [r.pos for r in found] == list(range(len(TOKENS)))
    ids = {(r.kind, r.name): r.id for r in rows.collect()}
    assert {r.target for r in found if r.node == f"m#{ids['Arg', 'n']}"} == {"number"} == {r.target for r in found if r.token == "missing" and r.target}
    assert {r.target for r in found if r.node == f"m#{ids['VarDef', 'q']}"} == {"string"} and sum(r.token == "q" for r in found) == 2
    assert all(r.node is None for r in found if r.keyword) and any(r.node == "unknown:g" for r in found)


def test_places_are_nested(spark):
    rows = rows_of(spark, MODULE)
    places = {r.id: r for r in syntax_text.tour(rows).collect()}
    parents = {r.id: r.parent for r in rows.collect()}
    assert sorted(x for r in places.values() for x in (r.enter, r.leave)) == list(range(2 * len(parents)))
    above = lambda i: [] if parents[i] is None else [parents[i], *above(parents[i])]
    for i in parents:
        assert {j for j in parents if places[j].enter < places[i].enter and places[i].leave < places[j].leave} == set(above(i))
        assert places[i].children == sum(p == i for p in parents.values())
    blocks = {(r.id, r.inner) for r in syntax_text.inside(rows, ["Block"]).collect()}
    kinds = {r.id: r.kind for r in rows.collect()}
    assert blocks == {(j, i) for i in parents for j in above(i) if kinds[j] == "Block"}
    assert syntax_text.source_text(rows.limit(0)).count() == 0
