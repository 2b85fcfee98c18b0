"""Programs as rows: JSON syntax trees of modules taken apart into one row per node.

A module's text is read leniently, its classes and interfaces are rewritten into
plainer trees, and the trees are walked in preorder.  All of that happens inside
one module; everything across modules is left to joins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators import lattice

NODE_SCHEMA = (
    "project string, module string, id int, parent int, role string, pos int, block int, kind string, name string, value string, "
    "type string, mark string, exported string, is_const boolean, line int, path string, alias string, scopes array<int>"
)
COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
#: The columns between kind and scopes.
FACTS = COLUMNS[COLUMNS.index("kind") + 1 : -1]
EXTENSIONS = (".d.ts", ".tsx", ".ts")
CONSTRUCTOR = "CONSTRUCTOR"

# Names that every program may use without a definition.
SPECIAL_NAMES = ["super", "this", "undefined", "$Async", "$Spread", "$Switch", "$Case", "$TypeOf", "$Delete", "$Yield", "$Template"]

_CLOSING = r"(?:\s|//[^\n]*|/\*.*?\*/)*[\]}]"
#: Runs that are left as they are; single-quoted strings, comments, and commas before a closing bracket.
_TOKEN = re.compile(rf'''((?:[^"'/,]++|"(?:[^"\\]++|\\.)*+"|,(?!{_CLOSING}))++)|'(?:\\.|[^'\\])*'|//[^\n]*|/\*.*?\*/|,(?={_CLOSING})''', re.DOTALL)
#: In text without backslashes and single quotes: commas before a closing bracket, and where a comment may begin.
_SUSPECT = re.compile(r",(?=\s*[\]}])|(,(?=\s*/)|/)")


def _plain(m: re.Match) -> str:
    t = m[0]
    if m[1]:
        return t
    return json.dumps(re.sub(r"\\(.)", r"\1", t[1:-1], flags=re.DOTALL)) if t[0] == "'" else ""


def _without_commas(text: str) -> str:
    """What _TOKEN makes of text without backslashes and single quotes: a place is outside of strings if an even number of quotes stands before."""
    parts, at, seen, quotes = [], 0, 0, 0
    for m in _SUSPECT.finditer(text):
        place = m.start()
        quotes += text.count('"', seen, place)
        seen = place
        if quotes % 2:
            continue
        parts.append(text[at:place])
        if m[1]:  # comments may hold quotes
            return "".join([*parts, _TOKEN.sub(_plain, text[place:])])
        at = place + 1
    return "".join([*parts, text[at:]])


def read_lenient(text: str):
    """JSON with comments, trailing commas and single-quoted strings."""
    if "\\" not in text and "'" not in text:
        try:
            return json.loads(_without_commas(text))
        except ValueError:
            pass  # the longer way says where it is wrong
    return json.loads(_TOKEN.sub(_plain, text))


def module_path(name: str) -> str:
    for e in EXTENSIONS:
        name = name.removesuffix(e)
    return name


_NO_FLAGS = {"exported": None, "get": False, "set": False, "abstract": False, "async": False}


def modifiers(node: dict) -> dict:
    """is_const, exported (default, public or null), and the flags get, set, abstract, async."""
    flags = node.get("modifiers")
    if not flags:
        return {"is_const": bool(node.get("isConst")), **_NO_FLAGS}
    flags = set(flags)
    exported = ("default" if "default" in flags else "public") if "export" in flags else None
    return {"is_const": bool(node.get("isConst")) or "const" in flags, "exported": exported} | {f: f in flags for f in ("get", "set", "abstract", "async")}


def as_block(stmts: list[dict]) -> dict:
    """The only statement if it is a block, else a block of them."""
    return stmts[0] if len(stmts) == 1 and stmts[0]["category"] == "BlockStmt" else {"category": "BlockStmt", "stmts": stmts}


def function_name(node: dict) -> str:
    return ("$Async_" if modifiers(node)["async"] else "") + node["name"]


def plain_class(node: dict) -> list[dict]:
    """A class as a namespace of its static members, with the constructor, and a class of instance members.

    Fields with initial values, and public constructor arguments, are set at the
    head of the constructor, after this and super and the lambdas they use.  An
    abstract class has no constructor in its namespace.  Methods know this and super, too.
    """
    name, flags = node["name"], modifiers(node)
    own_type = {"category": "TVar", "name": name}
    fields, statics, sets = [], [], []
    assign = lambda field, value: {"category": "AssignStmt", "lhs": {"category": "Access", "expr": {"category": "Var", "name": "this"}, "field": field}, "rhs": value}
    for v in node.get("vars") or []:
        mark, init, static, span = v["value"]
        if static:
            statics.append({"category": "VarDef", "x": v["name"], "mark": mark, "init": init, "isConst": True, "modifiers": [m for m in node.get("modifiers") or [] if m in ("export", "default")], "srcSpan": span})
        else:
            fields.append({"name": v["name"], "mark": mark, "span": span})
            if init is not None:
                sets.append(assign(v["name"], init))
    given = node.get("constr") or {"args": [], "body": {"category": "BlockStmt", "stmts": []}, "publicVars": []}
    public = set(given.get("publicVars") or [])
    for a in given["args"]:
        if a["name"] in public:
            fields.append({"name": a["name"], "mark": a["value"][0], "span": a["value"][1]})
            sets.append(assign(a["name"], {"category": "Var", "name": a["name"]}))
    fixed = {"category": "Fixed", "ty": own_type}
    ambient = [{"category": "VarDef", "x": x, "mark": fixed, "init": None, "isConst": True, "modifiers": []} for x in ("this", "super")]
    body = [*ambient, *(node.get("instanceLambdas") or []), *sets, *as_block([given["body"]])["stmts"]]
    constructor = {"category": "FuncDef", "name": CONSTRUCTOR, "tyVars": node.get("tyVars") or [], "args": given["args"], "returnType": [fixed, None], "body": as_block(body), "modifiers": []}
    methods = [f | {"body": as_block([*ambient, *as_block([f["body"]])["stmts"]])} for f, static in node.get("funcDefs") or [] if not static]
    static_methods = [f for f, static in node.get("funcDefs") or [] if static]
    members = [*(node.get("staticLambdas") or []), *statics, *([] if flags["abstract"] else [constructor]), *static_methods]
    space = {"category": "NamespaceStmt", "name": name, "block": {"category": "BlockStmt", "stmts": members}, "modifiers": node.get("modifiers") or []}
    return [space, node | {"fields": fields, "methods": methods}]


def merged_interfaces(stmts: list[dict]) -> list[dict]:
    """Type aliases first, those of one name merged field by field; blocks opened, namespaces done inside."""
    aliases: dict[str, dict] = {}
    rest: list[dict] = []
    for s in stmts:
        if s["category"] == "TypeAliasStmt":
            now = dict(s, of=lattice.from_json(s["type"]), superTypes=list(s.get("superTypes") or []))
            if s["name"] in aliases:
                old = aliases[s["name"]]
                now |= {"of": lattice.merge_objects(old["of"], now["of"]), "superTypes": old["superTypes"] + now["superTypes"]}
            aliases[s["name"]] = now
        elif s["category"] == "BlockStmt":
            rest += merged_interfaces(s["stmts"])
        elif s["category"] == "NamespaceStmt":
            rest.append(s | {"block": {"category": "BlockStmt", "stmts": merged_interfaces(as_block([s["block"]])["stmts"])}})
        else:
            rest.append(s)
    return [*aliases.values(), *rest]


def opened(stmts: Iterable[dict]) -> list[dict]:
    """Statements with all classes, at any depth, rewritten by plain_class."""
    out = []
    for s in stmts:
        if s["category"] == "ClassDef":
            space, cls = plain_class(s)
            space["block"]["stmts"] = opened(space["block"]["stmts"])
            out += [space, cls | {"methods": opened(cls["methods"])}]
        else:
            inside = {k: as_block(opened([s[k]])) for k in ("branch1", "branch2", "body", "block") if isinstance(s.get(k), dict)}
            out.append(s | inside | ({"stmts": opened(s["stmts"])} if s["category"] == "BlockStmt" else {}))
    return out


class Walk:
    """Rows of one module, in preorder."""

    def __init__(self, project: str, module: str):
        self.base = (project, module)
        self.rows: list[tuple] = []
        self.scopes: dict[int, list[int]] = {0: [0]}

    def add(self, kind: str, parent: int | None, role: str, pos: int, block: int, **facts) -> int:
        own = len(self.rows)
        self.rows.append((*self.base, own, parent, role, pos, block, kind, *map(facts.get, FACTS), self.scopes[block]))
        if kind == "Block":  # scopes from the outermost to the block
            self.scopes[own] = [*self.scopes[block], own]
        return own

    @staticmethod
    def marked(mark) -> dict:
        """mark (user, inferred, fixed or missing) and type of an annotation."""
        if not isinstance(mark, dict):
            return {"mark": "missing"}
        kind = {"UserAnnot": "user", "Inferred": "inferred", "Fixed": "fixed"}[mark["category"]]
        return {"mark": kind, "type": lattice.to_text(lattice.from_json(mark["ty"]))}

    @staticmethod
    def erased(facts: dict, variables: list[str]) -> dict:
        if variables and facts.get("type"):
            facts["type"] = lattice.to_text(lattice.monotype(lattice.from_text(facts["type"]), set(variables)))
        return facts

    def block(self, node: dict, parent: int, role: str, pos: int, block: int) -> int:
        own = self.add("Block", parent, role, pos, block)
        for i, s in enumerate(as_block([node])["stmts"]):
            self.statement(s, own, "stmt", i, own)
        return own

    def function(self, s: dict, parent: int, role: str, pos: int, block: int) -> None:
        variables = [v for v in s.get("tyVars") or []]
        flags = modifiers(s)
        own = self.add("FuncDef", parent, role, pos, block, name=function_name(s), exported=flags["exported"])
        returned = s.get("returnType")
        scope = self.add("Block", own, "body", 0, block)
        for i, a in enumerate(s["args"]):
            mark, span = a["value"]
            self.add("Arg", own, "arg", i, scope, name=a["name"], line=span and span[0][0], **self.erased(self.marked(mark), variables))
        result = self.marked(returned[0]) if returned else {"mark": "missing"}
        self.add("Result", own, "result", 0, scope, **self.erased(result, variables))
        for i, x in enumerate(as_block([s["body"]])["stmts"]):
            self.statement(x, scope, "stmt", i, scope)

    def statement(self, s: dict, parent: int, role: str, pos: int, block: int) -> None:
        kind = s["category"]
        flags = modifiers(s)
        public = {"exported": flags["exported"]}
        if kind == "VarDef":
            span = s.get("srcSpan")
            own = self.add(kind, parent, role, pos, block, name=s["x"], is_const=flags["is_const"], line=span and span[0][0], **public, **self.marked(s["mark"]))
            self.maybe(s.get("init"), own, "init", block)
        elif kind == "AssignStmt":
            own = self.add("Assign", parent, role, pos, block)
            self.expression(s["lhs"], own, "lhs", 0, block)
            self.expression(s["rhs"], own, "rhs", 0, block)
        elif kind == "ExprStmt":
            own = self.add("Return" if s.get("isReturn") else "Expr", parent, role, pos, block)
            self.expression(s["expr"], own, "expr", 0, block)
        elif kind in ("IfStmt", "WhileStmt"):
            own = self.add(kind.removesuffix("Stmt"), parent, role, pos, block)
            self.expression(s["cond"], own, "cond", 0, block)
            for i, k in enumerate(("branch1", "branch2") if kind == "IfStmt" else ("body",)):
                self.block(s[k], own, k, i, block)
        elif kind == "CommentStmt":
            self.add("Comment", parent, role, pos, block, value=s["text"])
        elif kind == "BlockStmt":
            self.block(s, parent, role, pos, block)
        elif kind == "NamespaceStmt":
            own = self.add("Namespace", parent, role, pos, block, name=s["name"], **public)
            self.block(s["block"], own, "body", 0, block)
        elif kind == "FuncDef":
            self.function(s, parent, role, pos, block)
        elif kind == "TypeAliasStmt":
            of = s["of"] if "of" in s else lattice.from_json(s["type"])
            of = lattice.monotype(of, set(s.get("tyVars") or []))
            self.add("TypeAlias", parent, role, pos, block, name=s["name"], type=lattice.to_text(of), value=",".join(s.get("superTypes") or []) or None, **public)
        elif kind == "ClassDef":
            own = self.add("Class", parent, role, pos, block, name=s["name"], value=",".join(s.get("superTypes") or []) or None, **public)
            variables = list(s.get("tyVars") or [])
            for i, f in enumerate(s["fields"]):
                self.add("Field", own, "field", i, block, name=f["name"], line=f["span"] and f["span"][0][0], **self.erased(self.marked(f["mark"]), variables))
            for i, f in enumerate(s["methods"]):
                self.function(f | {"tyVars": variables + list(f.get("tyVars") or [])}, own, "method", i, block)
        elif kind in ("ImportSingle", "ImportDefault", "ImportModule"):
            old = {"ImportSingle": s.get("oldName"), "ImportDefault": "default", "ImportModule": "*"}[kind]
            self.add("Import", parent, role, pos, block, name=old, alias=s["newName"], path=s["path"])
        elif kind in ("ExportSingle", "ExportDefault", "ExportModule"):
            old = {"ExportSingle": s.get("oldName"), "ExportDefault": s.get("newName"), "ExportModule": "*"}[kind]
            new = {"ExportSingle": s.get("newName"), "ExportDefault": "default", "ExportModule": "*"}[kind]
            self.add("Export", parent, role, pos, block, name=old, alias=new, path=s.get("from"))
        elif kind == "NamespaceAliasStmt":
            self.add("NamespaceAlias", parent, role, pos, block, name=s["name"], value=s["rhs"])
        else:
            raise ValueError(f"unknown statement: {kind}")

    def maybe(self, e: dict | None, parent: int, role: str, block: int) -> None:
        if e is not None:
            self.expression(e, parent, role, 0, block)

    def expression(self, e: dict, parent: int, role: str, pos: int, block: int) -> None:
        kind = e["category"]
        facts = self.marked(e.get("mark"))
        inside: list[tuple[str, dict]] = []
        label = None
        if kind == "Var":
            self.add(kind, parent, role, pos, block, **facts, name=e["name"])
            return
        if kind == "Const":
            facts |= {"value": e["value"], "type": lattice.to_text(lattice.from_json(e["ty"])), "line": e.get("line")}
        elif kind == "FuncCall":
            inside = [("func", e["f"]), *(("arg", a) for a in e.get("args") or [])]
        elif kind == "ObjLiteral":
            inside = [(f["name"], f["value"]) for f in e.get("fields") or []]
            label = "field"
        elif kind == "Access":
            facts["name"] = e["field"]
            inside = [("object", e["expr"])]
        elif kind == "IfExpr":
            inside = [("cond", e["cond"]), ("then", e["e1"]), ("else", e["e2"])]
        elif kind == "Cast":
            facts["type"] = lattice.to_text(lattice.from_json(e["ty"]))
            inside = [("expr", e["expr"])]
        else:
            raise ValueError(f"unknown expression: {kind}")
        own = self.add({"FuncCall": "Call", "ObjLiteral": "Object"}.get(kind, kind), parent, role, pos, block, **facts)
        first = len(inside) - sum(r == "arg" for r, _ in inside)
        for i, (r, x) in enumerate(inside):
            self.expression(x, own, f"{label}:{r}" if label else r, i - first if r == "arg" else i if label else 0, block)


def module_rows(project: str, text: str) -> list[tuple]:
    """Rows of one module {name, stmts}, values in the order of COLUMNS; a node `Module` stands at its root."""
    tree = read_lenient(text)
    walk = Walk(project, module_path(tree["name"]))
    root = walk.add("Module", None, "root", 0, 0, name=tree["name"], is_const=tree["name"].endswith(".d.ts"))
    for i, s in enumerate(merged_interfaces(opened(tree.get("stmts") or []))):
        walk.statement(s, root, "stmt", i, root)
    return walk.rows


def row_of(**values) -> tuple:
    """A row with these values and nulls."""
    return tuple(values.get(c) for c in COLUMNS)


ARROW_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
ARROW = pa.schema([(name, ARROW_KINDS[kind]) for name, kind in map(str.split, NODE_SCHEMA.split(", "))])


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows as an Arrow batch of NODE_SCHEMA."""
    columns = zip(*rows, strict=True) if rows else [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def parse_modules(rows: DataFrame) -> DataFrame:
    """rows(project, json) -> NODE_SCHEMA: a row per node of every module, as `module_rows` gives them.

    A text that is not a module gives one row of kind Error with the reason as
    value; null texts give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for project, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                try:
                    found += module_rows(project, text.as_py())
                except (ValueError, KeyError, TypeError) as e:
                    found.append(row_of(project=project, id=0, role="root", pos=0, block=0, kind="Error", value=f"{type(e).__name__}: {e}", scopes=[0]))
                if len(found) > 20_000:
                    yield packed_rows(found)
                    found = []
            if found:
                yield packed_rows(found)

    return rows.select("project", "json").mapInArrow(run, NODE_SCHEMA)
