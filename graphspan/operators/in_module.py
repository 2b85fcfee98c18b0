"""What one module says by itself, from its rows in memory: names, flat statements, text, tokens, exports.

A module is parsed whole in one place, and none of this looks beyond it, so nothing is
shuffled or kept on disk on the way, however many modules there are.  The rules
are those of `resolution`, `lowering` and `syntax_text`, which join rows of
modules wherever these lie; those are needed for names that come from other modules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.program import ARROW_KINDS, COLUMNS, module_rows
from .lowering import DEFINITIONS, RELATIONS
from .resolution import BASIC_TYPES, RESULT, SLOTS
from .syntax_text import INDENT, MISSING, ROLES

_, _, ID, PARENT, ROLE, POS, BLOCK, KIND, NAME, VALUE, TYPE, MARK, EXPORTED, IS_CONST, _, PATH, ALIAS, SCOPES = range(len(COLUMNS))
BASIC = {**{n: n for n in BASIC_TYPES.values()}, **BASIC_TYPES}
RANKS = {r: i for i, r in enumerate(ROLES)}
#: The columns of a flat statement.
STATEMENT = ["id", "kind", "v", "rhs", "rhs2", "cond", "type_node", "args"]
OF_KIND: dict[str, list[tuple[str, int, int]]] = {}
for _kind, _category, _a, _b in RELATIONS:
    OF_KIND.setdefault(_kind, []).append((_category, STATEMENT.index(_a), STATEMENT.index(_b)))
FLAT = {"VarDef", "Assign", "Return", "If", "While", "Call", "Object", "Access", "IfExpr", "Cast", "FuncDef", "Class"}
NAMED = {"Var", "VarDef", "Arg", "FuncDef", "Class", "Field"}

Token = tuple[str | None, bool, str | None, str | None]


def keys(*names: str) -> list[Token]:
    return [(n, True, None, None) for n in names]


def word(text: str | None) -> Token:
    return text, False, None, None


def put(*parts: str | None) -> str:
    """The parts as one text, or nothing if one of them is missing."""
    return "" if None in parts else "".join(parts)


class Module:
    """The rows of one module, in the order of their ids."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.module = rows, rows[0][1]
        self.ids = [f"{self.module}#{i}" for i in range(len(rows))]

    # names

    def definitions_of(self) -> dict[tuple, int]:
        """(block, name, slot) to the last row that defines it."""
        return {(r[BLOCK], RESULT if r[KIND] == "Result" else r[NAME], slot): r[ID] for r in self.rows if r[KIND] in SLOTS and r[ROLE] != "method" for slot in SLOTS[r[KIND]]}

    def names(self) -> list[tuple[int, str, str, str | None]]:
        """id, name, slot, target of every use: the innermost definition around it, a basic type, or unknown."""
        known, out = self.definitions_of(), []

        def target(name: str | None, slot: str, scopes: list[int]) -> str | None:
            if name is None:
                return None
            for block in reversed(scopes):
                if (own := known.get((block, name, slot))) is not None:
                    return self.ids[own]
            return f"lib:{BASIC[name]}" if slot == "type" and name in BASIC else f"unknown:{name}"

        for r in self.rows:
            kind = r[KIND]
            if kind in ("Var", "Return"):
                name = RESULT if kind == "Return" else r[NAME]
                out.append((r[ID], name, "term", target(name, "term", r[SCOPES])))
            elif kind in ("Class", "TypeAlias") and r[VALUE] is not None:
                out += [(r[ID], name, "type", target(name, "type", r[SCOPES])) for name in r[VALUE].split(",")]
        return out

    @staticmethod
    def constant(row: tuple) -> str | None:
        """The library term of a constant's type."""
        if row[KIND] != "Const" or row[TYPE] is None:
            return None
        return f"lib:{BASIC.get(row[TYPE], row[TYPE])}"

    def values(self, targets: dict[int, str | None]) -> list[str]:
        """What every row stands for: variables for their target, constants for the term of their type, others for themselves."""
        return [(targets.get(i) if r[KIND] == "Var" else self.constant(r)) or own for i, (r, own) in enumerate(zip(self.rows, self.ids, strict=True))]

    # flat statements

    def statements(self) -> list[tuple]:
        """Flat statements as `resolution.lower_statements` gives them, without project and module; args as (label, arg)."""
        names = self.names()
        targets = {i: target for i, _, slot, target in names if slot == "term"}
        supers: dict[int, list[str]] = {}
        for i, _, slot, target in names:
            if slot == "type":
                supers.setdefault(i, []).append(target)
        v = self.values(targets)
        below: dict[int, list[tuple]] = {}
        for r in self.rows:
            if r[PARENT] is not None and r[KIND] not in ("Block", "Comment", "Import", "Export"):
                below.setdefault(r[PARENT], []).append((r[ROLE], r[POS], r[NAME] is not None, r[NAME] or "", v[r[ID]], r[NAME]))
        out = []
        for r in self.rows:
            kind, own = r[KIND], r[ID]
            if kind not in FLAT:
                continue
            kids = sorted(below.get(own, ()))
            one = {k[0]: k[4] for k in reversed(kids)}.get  # the first of each role
            left, right, right2, cond, stated, args = v[own], None, None, None, None, None
            rights: list[str | None] = []
            if kind == "VarDef":
                right = one("init")
            elif kind == "Assign":
                left, right = one("lhs"), one("rhs")
            elif kind == "Return":
                left, right = targets.get(own), one("expr")
            elif kind in ("If", "While"):
                left, cond = None, one("cond")
            elif kind == "IfExpr":
                right, right2, cond = one("then"), one("else"), one("cond")
            elif kind == "Cast":
                right, stated = one("expr"), None if r[TYPE] is None else f"lib:{BASIC[r[TYPE]]}" if r[TYPE] in BASIC else f"type:{r[TYPE]}"
            elif not kids:
                pass
            elif kind == "Call":
                args = [("func", k[4]) for k in kids if k[0] == "func"] + [(str(k[1]), k[4]) for k in kids if k[0] == "arg"]
            elif kind == "Object":
                args = [(k[0][6:], k[4]) for k in kids if k[0].startswith("field:")]
            elif kind == "Access":
                args = [(r[NAME], k[4]) for k in kids if k[0] == "object"]
            elif kind == "FuncDef":
                args = [("result", k[4]) for k in kids if k[0] == "result"] + [(str(k[1]), k[4]) for k in kids if k[0] == "arg"]
            else:
                args = [(k[5], k[4]) for k in kids if k[0] in ("field", "method")]
            if kind == "Class":  # a class and each of its super types
                kind, rights = "ClassDef", sorted(supers.get(own, ()))
            out += [(own, kind, left, x, right2, cond, stated, args) for x in rights or [right]]
        return out

    def relations(self) -> list[tuple[str, str, str]]:
        """lhs, rhs, category: without self loops and repeats."""
        pairs = ((s[a], s[b], category) for s in self.statements() for category, a, b in OF_KIND.get(s[1], ()))
        return list(dict.fromkeys(p for p in pairs if p[0] is not None and p[1] is not None and p[0] != p[1]))

    def definitions(self) -> list[tuple[str, str, int, str, str]]:
        """node, define, pos, label, arg of every argument, field or result of a definition."""
        return [(s[2], DEFINITIONS[s[1]], i, label, arg) for s in self.statements() if s[1] in DEFINITIONS for i, (label, arg) in enumerate(s[7] or ())]

    # order of what is written

    def tour(self) -> Iterator[tuple[tuple, bool, int, int]]:
        """(row, whether it is entered or left, blocks and classes around it, number of children), children in the order in which they are written."""
        below: dict[int | None, list[tuple]] = {}
        for r in self.rows:
            below.setdefault(r[PARENT], []).append(r)
        for kids in below.values():
            if len(kids) > 1:
                kids.sort(key=lambda r: (RANKS.get(r[ROLE], len(ROLES)), r[POS], r[ID]))
        todo = [(r, True, 0) for r in reversed(below.get(None, ()))]
        while todo:
            r, enters, depth = todo.pop()
            kids = below.get(r[ID], ())
            yield r, enters, depth, len(kids)
            if enters:
                todo.append((r, False, depth))
                inside = depth + (r[KIND] in ("Block", "Class"))
                todo += [(k, True, inside) for k in reversed(kids)]

    def text(self) -> list[tuple[str]]:
        """The source text, if there are statements."""
        pieces = []
        for r, enters, depth, children in self.tour():
            above = None if r[PARENT] is None else self.rows[r[PARENT]][KIND]
            pieces.append((entered if enters else left)(r, above, INDENT * depth, children))
        text = "".join(pieces)
        return [(text,)] if text else []

    def tokens(self) -> list[tuple]:
        """pos, token, keyword, node, target: the flat statements as tokens, as `syntax_text.token_stream` gives them."""
        rows = self.rows
        stated = {self.ids[r[ID]]: r[TYPE] for r in rows if r[MARK] == "user" and r[KIND] in ("VarDef", "Arg", "Result", "Field")}
        nodes = self.values({i: target for i, _, slot, target in self.names() if slot == "term"})
        tk, below = [], {}
        for r, node in zip(rows, nodes, strict=True):
            name = r[NAME] if r[KIND] in NAMED else None
            if name is None and (constant := self.constant(r)):
                name = constant.removeprefix("lib:")
            tk.append((MISSING if name is None else name, False, node, stated.get(node)))
            if r[PARENT] is not None and r[KIND] not in ("Block", "Comment"):
                below.setdefault(r[PARENT], []).append((r[POS], r[ROLE], r[ID]))
        for kids in below.values():
            kids.sort()
        out: list[Token] = []
        for r, enters, _, _ in self.tour():
            kind = r[KIND]
            if enters and kind not in ENTERED or not enters and kind not in LEFT and r[ROLE] != "cond":
                continue
            kids, me = below.get(r[ID], ()), tk[r[ID]]
            of = lambda role: [tk[i] for _, k, i in kids if k == role]  # noqa: B023, E731
            if enters:
                if kind == "FuncDef":
                    out += [*BEGIN_FUNC, me, *of("arg"), *BEFORE_RETURN, *of("result")]
                elif kind == "Class":
                    supers = [] if r[VALUE] is None else map(word, r[VALUE].split(","))
                    out += [*BEGIN_CLASS, me, *supers, *BEGIN_OBJECT, *(t for k in of("field") for t in (word(k[0]), k))]
                else:
                    out += ENTERED[kind]
                continue
            if kind in MADE:
                if kind == "Object":
                    inside = [t for _, k, i in kids if k.startswith("field:") for t in (word(k[6:]), tk[i])]
                elif kind == "Access":
                    inside = [*of("object"), word(r[NAME])]
                elif kind == "Cast":
                    inside = [*of("expr"), word(r[TYPE])]
                else:
                    inside = [t for role in MADE[kind] for t in of(role)]
                out += [*BEGIN_CONST, me, *keys(f"begin{kind}"), *inside, *keys(f"end{kind}", "endVarDef")]
            elif kind == "VarDef":
                out += [*(BEGIN_CONST if r[IS_CONST] else BEGIN_LET), me, *of("init"), *END_VAR]
            elif kind == "Assign":
                out += [*BEGIN_ASSIGN, *of("lhs"), *of("rhs"), *END_ASSIGN]
            elif kind == "Return":
                out += [*RETURN, *of("expr")]
            elif kind in LEFT:
                out += LEFT[kind]
            if r[ROLE] == "cond" and (above := rows[r[PARENT]][KIND]) in ("If", "While"):  # a condition's statements stand before the statement that asks it
                out += [*keys(f"begin{above}"), me]
        return [(i, *t) for i, t in enumerate(out)]

    # what other modules may ask for

    def exports(self) -> list[tuple[str, str, str]]:
        """symbol, slot, node: definitions at the top with export or export default, and what export statements without a path name."""
        top: dict[str | None, list[tuple[str, str]]] = {}
        for (block, name, slot), own in self.definitions_of().items():
            if block == 0 and name is not None:
                top.setdefault(name, []).append((slot, self.ids[own]))
        asked = []
        for r in self.rows:
            if r[BLOCK] == 0 and r[EXPORTED] is not None:
                asked += [(r[NAME], r[NAME])] + [(r[NAME], "default")] * (r[EXPORTED] == "default")
            if r[KIND] == "Export" and r[PATH] is None and r[NAME] != "*":
                asked.append((r[NAME], r[ALIAS]))
        return list(dict.fromkeys((symbol, *d) for name, symbol in asked for d in top.get(name, ())))

    def links(self) -> list[tuple[str, str, str | None]]:
        """path, old, new: exports of what other modules export; * and * for all."""
        return [(r[PATH], "default" if r[NAME] is None else r[NAME], r[ALIAS]) for r in self.rows if r[KIND] == "Export" and r[PATH] is not None]

    def shared(self) -> list[tuple]:
        """symbol, slot, node of its exports, and path, old, new of its links, each with nulls for the others."""
        return [(*e, None, None, None) for e in self.exports()] + [(None, None, None, *x) for x in self.links()]


BEGIN_FUNC, BEFORE_RETURN, BEGIN_CLASS, BEGIN_OBJECT = keys("beginFuncDef"), keys("beforeReturn"), keys("beginClassDef"), keys("beginObject")
BEGIN_CONST, BEGIN_LET, END_VAR = keys("beginVarDef", "const"), keys("beginVarDef", "let"), keys("endVarDef")
BEGIN_ASSIGN, END_ASSIGN, RETURN = keys("beginAssign"), keys("endAssign"), keys("return")
ENTERED = {"Module": keys("beginModule"), "Block": keys("beginBlock"), "FuncDef": [], "Class": []}
#: Expressions that are definitions of nodes without a name, and the roles of what they are made of.
MADE = {"Call": ["func", "arg"], "IfExpr": ["cond", "then", "else"], "Object": [], "Access": [], "Cast": []}
LEFT = {"If": keys("endIf"), "While": keys("endWhile"), "Block": keys("endBlock"), "FuncDef": keys("endFuncDef"), "Class": keys("endObject", "endClassDef"), "Module": keys("endModule")} | dict.fromkeys([*MADE, "VarDef", "Assign", "Return"], [])


def bare(r: tuple, children: int) -> bool:
    """Whether a row is an else without statements, which is not written."""
    return r[KIND] == "Block" and r[ROLE] == "branch2" and children == 0


def entered(r: tuple, above: str | None, margin: str, children: int) -> str:
    """The text that a row puts where it is entered."""
    kind, role = r[KIND], r[ROLE]
    name = r[NAME] or ""
    comma = ", " if r[POS] > 0 else ""
    public = "" if r[EXPORTED] is None else "export default " if r[EXPORTED] == "default" else "export "
    typed = "" if r[TYPE] is None else f": {r[TYPE]}"
    supers = "" if r[VALUE] is None else " extends " + r[VALUE].replace(",", " with ")
    if above == "Call" and role == "arg":
        before = comma
    elif above == "Object":
        before = f"{comma}{role[6:]}: "
    elif above == "VarDef" or above == "Assign" and role == "rhs":
        before = " = "
    elif above == "If" and role == "branch2" and not bare(r, children):
        before = f"{margin}else\n"
    else:
        before = ""
    match kind:
        case "VarDef":
            return put(before, margin, public, "const " if r[IS_CONST] else "let ", name, typed)
        case "Assign" | "Expr":
            return before + margin
        case "Return" | "If" | "While":
            return before + margin + {"Return": "return ", "If": "if (", "While": "while ("}[kind]
        case "Block" if not bare(r, children):
            return f"{before}{margin}{{\n"
        case "FuncDef":
            return f"{before}{margin}{public}function {name} ("
        case "Arg":
            return before + (comma if role == "arg" else "") + name + typed
        case "Result":
            return f"{before}){typed}\n"
        case "Class":
            return f"{before}{margin}{public}class {name}{supers} {{\n"
        case "Field":
            return f"{before}{margin}{name}{typed};\n"
        case "TypeAlias":
            return f"{before}{margin}{public}type {name} = {'any' if r[TYPE] is None else r[TYPE]}{supers};\n"
        case "Namespace":
            return f"{before}{margin}{public}namespace {name}\n"
        case "NamespaceAlias":
            return f"{before}{margin}namespace {name} = {r[VALUE] or ''};\n"
        case "Comment":
            return f"{before}{margin}/* {r[VALUE] or ''} */\n"
        case "Import":
            named = r[ALIAS] if r[NAME] == "default" else put("* as ", r[ALIAS]) or None if r[NAME] == "*" else member(r)
            return put(before, margin, "import ", named, ' from "', r[PATH], '";\n')
        case "Export":
            return put(before, margin, "export ", member(r), "" if r[PATH] is None else f' from "{r[PATH]}"', ";\n")
        case "Var":
            return before + name
        case "Const":
            return before + ("null" if r[VALUE] is None else r[VALUE])
        case "Object":
            return before + "{"
        case "IfExpr" | "Cast":
            return before + "("
    return before


def member(r: tuple) -> str:
    """What an import or export statement names."""
    if r[NAME] == "*":
        return "*"
    name = r[NAME] or ""
    return f"{{{name}}}" if r[NAME] is not None and r[NAME] == r[ALIAS] else f"{{{name} as {r[ALIAS] or ''}}}"


def left(r: tuple, above: str | None, margin: str, children: int) -> str:
    """The text that a row puts where it is left."""
    kind, role = r[KIND], r[ROLE]
    if kind in ("VarDef", "Assign", "Expr", "Return"):
        closes = ";\n"
    elif kind == "Block" and not bare(r, children) or kind == "Class":
        closes = f"{margin}}}\n"
    elif kind in ("Call", "IfExpr"):
        closes = ")"
    elif kind == "Object":
        closes = "}"
    elif kind == "Access":
        closes = f".{r[NAME] or ''}"
    elif kind == "Cast":
        closes = f" as {'any' if r[TYPE] is None else r[TYPE]})"
    else:
        closes = ""
    if above == "Call" and role == "func":
        return closes + "("
    if above == "IfExpr" and role in ("cond", "then"):
        return closes + (" ? " if role == "cond" else " : ")
    if above in ("If", "While") and role == "cond":
        return closes + ")\n"
    return closes


def each_module(texts: DataFrame, found: Callable[[Module], Iterable[tuple]], schema: str) -> DataFrame:
    """texts(project, json) -> project, module, and the rows of schema that found gives of every module.

    Texts that are no module, and null texts, give nothing.
    """
    fields = [("project", pa.string()), ("module", pa.string()), *[(name, ARROW_KINDS[kind]) for name, kind in map(str.split, schema.split(", "))]]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)], [name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for project, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                try:
                    module = Module(module_rows(project, text.as_py()))
                except (ValueError, KeyError, TypeError):
                    continue
                out += [(project, module.module, *row) for row in found(module)]
                if len(out) > 20_000:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    return texts.select("project", "json").mapInArrow(run, f"project string, module string, {schema}")
