"""Source text and token streams of syntax rows, without walking trees.

A tour numbers where each node is entered and left, children in the order in which
they are written.  What a node puts before, between and after its children is then a piece of
text or a run of tokens at one of these numbers, and a module is its pieces in order: one grouping
gives the text of any tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, shuffled
from .resolution import KEY, basic_type, node_of

#: Order of a node's children by role; others come last, by position.
ROLES = ["func", "object", "cond", "lhs", "arg", "result", "init", "rhs", "expr", "then", "branch1", "body", "branch2", "else"]
INDENT = "  "


def tour(rows: DataFrame) -> DataFrame:
    """project, module, id, enter, leave, depth, children: of every row of modules.

    enter and leave count both kinds of events from 0 in each module; a node's
    descendants lie between its own.  depth: blocks and classes around the node.
    A module's rows meet in one task, module by module, after one shuffle.
    """
    rank = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(ROLES)], F.lit(len(ROLES)))
    dealt = rows.where("kind <> 'Error'").select(*KEY, "id", F.coalesce("parent", F.lit(-1)).alias("parent"), rank.alias("rank"), "pos", F.col("kind").isin("Block", "Class").alias("deeper"))
    dealt = dealt.repartition(*KEY).sortWithinPartitions(*KEY, "parent", "rank", "pos", "id")
    names = ["project", "module", "id", "enter", "leave", "depth", "children"]

    def numbered(found: list[tuple]) -> list[tuple]:
        below: dict[int, list[tuple[int, bool]]] = {}
        for project, module, own, parent, _, _, deeper in found:  # in order of parent, and among siblings
            below.setdefault(parent, []).append((own, deeper))
        out, at = [], 0
        todo = [(own, deeper, 0, None) for own, deeper in reversed(below.get(-1, []))]
        while todo:
            own, deeper, depth, entered = todo.pop()
            if entered is not None:
                out.append((project, module, own, entered, at, depth, len(below.get(own, ()))))
            else:
                todo.append((own, deeper, depth, at))
                todo += [(k, d, depth + deeper, None) for k, d in reversed(below.get(own, []))]
            at += 1
        return out

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int32()) for i, c in enumerate(zip(*out, strict=True))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    out += numbered(held)
                    held = []
                held.append(row)
            if len(out) > 20_000:
                yield packed(out)
                out = []
        if held:
            out += numbered(held)
        if out:
            yield packed(out)

    return dealt.mapInArrow(run, "project string, module string, id int, enter int, leave int, depth int, children int")


def _with_tour(rows: DataFrame) -> DataFrame:
    """rows with their tour, and the kind and name of the node above as above, above_name."""
    places = tour(rows).select(*[F.col(c).alias(f"_{c}") for c in (*KEY, "id")], "enter", "leave", "depth", "children")
    above = rows.select(*[F.col(c).alias(f"^{c}") for c in KEY], F.col("id").alias("^id"), F.col("kind").alias("above"))
    met = rows.join(shuffled(places), [F.col(c) == F.col(f"_{c}") for c in (*KEY, "id")])
    return met.join(shuffled(above), [*[F.col(c) == F.col(f"^{c}") for c in KEY], F.col("parent") == F.col("^id")], "left").select(*rows.columns, "enter", "leave", "depth", "children", "above")


def _first_of(role: str, *others: str) -> Column:
    return F.when((F.col("role") == role) & (F.col("pos") > 0), ", ").otherwise("")


def pieces(rows: DataFrame) -> DataFrame:
    """project, module, at, piece: text that a node puts where it is entered or left."""
    kind, above, role = F.col("kind"), F.col("above"), F.col("role")
    lit, name = F.lit, F.coalesce("name", F.lit(""))
    margin = F.repeat(F.lit(INDENT), F.col("depth"))
    public = F.when(F.col("exported") == "default", "export default ").when(F.col("exported").isNotNull(), "export ").otherwise("")
    typed = F.when(F.col("type").isNotNull(), F.concat(lit(": "), F.col("type"))).otherwise("")
    supers = F.when(F.col("value").isNotNull(), F.concat(lit(" extends "), F.replace("value", lit(","), lit(" with ")))).otherwise("")
    bare = (kind == "Block") & (role == "branch2") & (F.col("children") == 0)  # an else without statements is not written
    path = F.concat(lit('"'), F.col("path"), lit('"'))
    member = F.when(F.col("name") == "*", "*").when(F.col("name") == F.col("alias"), F.concat(lit("{"), name, lit("}"))).otherwise(F.concat(lit("{"), name, lit(" as "), F.coalesce("alias", lit("")), lit("}")))
    imported = F.when(F.col("name") == "default", F.col("alias")).when(F.col("name") == "*", F.concat(lit("* as "), F.col("alias"))).otherwise(member)
    before = (
        F.when((above == "Call") & (role == "arg"), _first_of("arg")).when((above == "Object"), F.concat(F.when(F.col("pos") > 0, ", ").otherwise(""), F.substring(role, F.lit(7), F.length(role)), lit(": ")))
        .when((above == "VarDef") | ((above == "Assign") & (role == "rhs")), lit(" = ")).when((above == "If") & (role == "branch2") & ~bare, F.concat(margin, lit("else\n"))).otherwise("")
    )
    opens = (
        F.when(kind == "VarDef", F.concat(margin, public, F.when(F.col("is_const"), "const ").otherwise("let "), name, typed)).when(kind.isin("Assign", "Expr"), margin).when(kind == "Return", F.concat(margin, lit("return ")))
        .when(kind == "If", F.concat(margin, lit("if ("))).when(kind == "While", F.concat(margin, lit("while ("))).when((kind == "Block") & ~bare, F.concat(margin, lit("{\n")))
        .when(kind == "FuncDef", F.concat(margin, public, lit("function "), name, lit(" ("))).when(kind == "Arg", F.concat(_first_of("arg"), name, typed)).when(kind == "Result", F.concat(lit(")"), typed, lit("\n")))
        .when(kind == "Class", F.concat(margin, public, lit("class "), name, supers, lit(" {\n"))).when(kind == "Field", F.concat(margin, name, typed, lit(";\n")))
        .when(kind == "TypeAlias", F.concat(margin, public, lit("type "), name, lit(" = "), F.coalesce("type", lit("any")), supers, lit(";\n"))).when(kind == "Namespace", F.concat(margin, public, lit("namespace "), name, lit("\n")))
        .when(kind == "NamespaceAlias", F.concat(margin, lit("namespace "), name, lit(" = "), F.coalesce("value", lit("")), lit(";\n"))).when(kind == "Comment", F.concat(margin, lit("/* "), F.coalesce("value", lit("")), lit(" */\n")))
        .when(kind == "Import", F.concat(margin, lit("import "), imported, lit(" from "), path, lit(";\n"))).when(kind == "Export", F.concat(margin, lit("export "), member, F.when(F.col("path").isNotNull(), F.concat(lit(" from "), path)).otherwise(""), lit(";\n")))
        .when(kind == "Var", name).when(kind == "Const", F.coalesce("value", lit("null"))).when(kind == "Object", lit("{")).when(kind.isin("IfExpr", "Cast"), lit("(")).otherwise("")
    )
    closes = (
        F.when(kind.isin("VarDef", "Assign", "Expr", "Return"), lit(";\n")).when((kind == "Block") & ~bare, F.concat(margin, lit("}\n"))).when(kind == "Class", F.concat(margin, lit("}\n")))
        .when(kind.isin("Call", "IfExpr"), lit(")")).when(kind == "Object", lit("}")).when(kind == "Access", F.concat(lit("."), name)).when(kind == "Cast", F.concat(lit(" as "), F.coalesce("type", lit("any")), lit(")"))).otherwise("")
    )
    after = (
        F.when((above == "Call") & (role == "func"), lit("(")).when((above == "IfExpr") & (role == "cond"), lit(" ? ")).when((above == "IfExpr") & (role == "then"), lit(" : "))
        .when(above.isin("If", "While") & (role == "cond"), lit(")\n")).otherwise("")
    )
    two = F.array(F.struct(F.col("enter").alias("at"), F.concat(before, opens).alias("piece")), F.struct(F.col("leave").alias("at"), F.concat(closes, after).alias("piece")))
    return _with_tour(rows).select(*KEY, F.explode(two).alias("p")).select(*KEY, "p.at", "p.piece").where("piece <> ''")


def source_text(rows: DataFrame) -> DataFrame:
    """project, module, text: the source of every module that has statements.  A module's pieces come together once, in order."""
    made = pieces(rows).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return made.select(*KEY, F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))


def inside(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """project, module, id, inner: every node within a node of some kinds, by their places in the tour; a range join within a module."""
    places = checkpointed(tour(rows))
    outer = places.join(shuffled(rows.where(F.col("kind").isin(*kinds)).select(*KEY, "id")), [*KEY, "id"]).select(*KEY, "id", F.col("enter").alias("lo"), F.col("leave").alias("hi"))
    inner = places.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("id").alias("inner"), F.col("enter").alias("at"))
    return outer.join(shuffled(inner), [*[F.col(c) == F.col(f"_{c}") for c in KEY], (F.col("at") > F.col("lo")) & (F.col("at") < F.col("hi"))]).select(*KEY, "id", "inner")


TOKEN = "struct<token:string,keyword:boolean,node:string,target:string>"
#: What stands for a node without a name.
MISSING = "missing"


def _keys(*names: str) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("token"), F.lit(True).alias("keyword"), F.lit(None).cast("string").alias("node"), F.lit(None).cast("string").alias("target")) for n in names])


def token_stream(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """project, module, pos, token, keyword, node, target: the flat statements of every module as tokens, in order.

    An expression that is no name or constant is the definition of a node without a name, where it
    is left; statements follow their expressions.  node: what a name stands for;
    target: the type that a user has given to that node.
    """
    none = F.lit(None).cast("string")
    stated = rows.where("mark = 'user' AND kind IN ('VarDef', 'Arg', 'Result', 'Field')").select(node_of().alias("_stated"), F.col("type").alias("target"))
    targets = resolved.where("slot = 'term'").select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("id").alias("_id"), F.col("target").alias("found"))
    met = rows.join(shuffled(targets), [*[F.col(c) == F.col(f"_{c}") for c in KEY], F.col("id") == F.col("_id")], "left").select(*rows.columns, "found")
    constant = F.when(F.col("kind") == "Const", F.coalesce(basic_type(F.col("type")), F.concat(F.lit("lib:"), "type")))
    own = F.coalesce(F.when(F.col("kind") == "Var", F.col("found")), constant, node_of())
    named = F.coalesce(F.when(F.col("kind").isin("Var", "VarDef", "Arg", "FuncDef", "Class", "Field"), F.col("name")), F.regexp_replace(constant, "^lib:", ""), F.lit(MISSING))
    met = met.withColumn("node", own).withColumn("token", named).join(shuffled(stated), F.col("node") == F.col("_stated"), "left").drop("_stated")
    met = checkpointed(met.withColumn("tk", F.struct("token", F.lit(False).alias("keyword"), "node", "target")))
    kids = met.where("parent IS NOT NULL AND kind NOT IN ('Block', 'Comment')").groupBy(*[F.col(c).alias(f"+{c}") for c in KEY], F.col("parent").alias("+id")).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "id", "tk"))).alias("kids"))
    placed = _with_tour(met).join(shuffled(kids), [*[F.col(c) == F.col(f"+{c}") for c in KEY], F.col("id") == F.col("+id")], "left")
    placed = placed.withColumn("kids", F.coalesce("kids", F.array().cast(kids.schema["kids"].dataType)))
    of = lambda role: F.transform(F.filter("kids", lambda k: k["role"] == role), lambda k: k["tk"])
    word = lambda text: F.struct(text.alias("token"), F.lit(False).alias("keyword"), none.alias("node"), none.alias("target"))
    nothing = F.array().cast(f"array<{TOKEN}>")
    kind, me = F.col("kind"), F.array("tk")
    labelled = lambda of_role, label: F.flatten(F.transform(F.filter("kids", of_role), lambda k: F.array(word(label(k)), k["tk"])))
    fields = labelled(lambda k: F.startswith(k["role"], F.lit("field:")), lambda k: F.substring(k["role"], F.lit(7), F.length(k["role"])))
    made = (
        F.when(kind == "Call", F.concat(_keys("beginCall"), of("func"), of("arg"), _keys("endCall"))).when(kind == "Object", F.concat(_keys("beginObject"), fields, _keys("endObject")))
        .when(kind == "Access", F.concat(_keys("beginAccess"), of("object"), F.array(word(F.col("name"))), _keys("endAccess"))).when(kind == "IfExpr", F.concat(_keys("beginIfExpr"), of("cond"), of("then"), of("else"), _keys("endIfExpr")))
        .when(kind == "Cast", F.concat(_keys("beginCast"), of("expr"), F.array(word(F.col("type"))), _keys("endCast")))
    )
    supers = F.transform(F.when(F.col("value").isNull(), F.array().cast("array<string>")).otherwise(F.split("value", ",")), word)
    enters = (
        F.when(kind == "Module", _keys("beginModule")).when(kind == "Block", _keys("beginBlock"))
        .when(kind == "FuncDef", F.concat(_keys("beginFuncDef"), me, of("arg"), _keys("beforeReturn"), of("result")))
        .when(kind == "Class", F.concat(_keys("beginClassDef"), me, supers, _keys("beginObject"), labelled(lambda k: k["role"] == "field", lambda k: k["tk"]["token"]))).otherwise(nothing)
    )
    leaves = (
        F.when(made.isNotNull(), F.concat(_keys("beginVarDef", "const"), me, made, _keys("endVarDef")))
        .when(kind == "VarDef", F.concat(_keys("beginVarDef"), F.when(F.col("is_const"), _keys("const")).otherwise(_keys("let")), me, F.coalesce(of("init"), nothing), _keys("endVarDef")))
        .when(kind == "Assign", F.concat(_keys("beginAssign"), of("lhs"), of("rhs"), _keys("endAssign"))).when(kind == "Return", F.concat(_keys("return"), of("expr"))).when(kind == "If", _keys("endIf")).when(kind == "While", _keys("endWhile"))
        .when(kind == "Block", _keys("endBlock")).when(kind == "FuncDef", _keys("endFuncDef")).when(kind == "Class", _keys("endObject", "endClassDef")).when(kind == "Module", _keys("endModule")).otherwise(nothing)
    )
    # a condition's statements stand before the statement that asks it
    asked = F.when((F.col("role") == "cond") & (F.col("above") == "If"), F.concat(_keys("beginIf"), me)).when((F.col("role") == "cond") & (F.col("above") == "While"), F.concat(_keys("beginWhile"), me)).otherwise(nothing)
    two = F.array(F.struct(F.col("enter").alias("at"), enters.alias("tokens")), F.struct(F.col("leave").alias("at"), F.concat(leaves, asked).alias("tokens")))
    runs = placed.select(*KEY, F.explode(two).alias("e")).where(F.size("e.tokens") > 0)
    ordered = runs.groupBy(*KEY).agg(F.sort_array(F.collect_list("e")).alias("e"))  # a module's runs come together once
    return ordered.select(*KEY, F.posexplode(F.flatten(F.transform("e", lambda x: x["tokens"]))).alias("pos", "t")).select(*KEY, "pos", "t.*")
