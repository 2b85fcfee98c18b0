"""Names to nodes, and nested syntax to flat statements, as joins over rows of syntax.

Rows are those of `parse_modules`.  A node of a program is named module#id, one of
the library lib:Name, and a name that nothing defines unknown:name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Stored, release, shuffled

# Library names of the basic types and of their constructors.
BASIC_TYPES = {
    "number": "Number", "string": "String", "boolean": "Boolean", "symbol": "Symbol", "void": "Void", "object": "Object", "array": "Array", "bigint": "BigInt",
    "NumberConstructor": "Number", "StringConstructor": "String", "BooleanConstructor": "Boolean", "SymbolConstructor": "Symbol",
    "ObjectConstructor": "Object", "ArrayConstructor": "Array", "BigIntConstructor": "BigInt",
}
#: What a definition of a kind defines: a term, a type or a namespace.
SLOTS = {"VarDef": ["term"], "FuncDef": ["term"], "Arg": ["term"], "Result": ["term"], "Class": ["type"], "TypeAlias": ["type"], "Namespace": ["term", "namespace"], "NamespaceAlias": ["namespace"]}
RESULT = "$result"
KEY = ["project", "module"]


def node_of(module: str = "module", id_: str = "id") -> Column:
    return F.concat(F.col(module), F.lit("#"), F.col(id_).cast("string"))


def basic_type(name: Column) -> Column:
    """lib:Name of a basic type, null for other names."""
    return F.concat(F.lit("lib:"), F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in BASIC_TYPES.items()], F.when(name.isin(*set(BASIC_TYPES.values())), name)))


def definitions_of(rows: DataFrame) -> DataFrame:
    """project, module, block, name, slot, node: what each block defines; the result of a function under a name of its own.

    Methods belong to their class, not to a block.  Of several definitions of a
    name in one block and slot the last one counts.
    """
    slots = F.coalesce(*[F.when(F.col("kind") == k, F.array(*map(F.lit, v))) for k, v in SLOTS.items()])
    name = F.when(F.col("kind") == "Result", F.lit(RESULT)).otherwise(F.col("name"))
    found = rows.where(F.col("kind").isin(*SLOTS) & (F.col("role") != "method")).select(*KEY, "block", name.alias("name"), F.explode(slots).alias("slot"), "id")
    last = found.groupBy(*KEY, "block", "name", "slot").agg(F.max("id").alias("id"))
    return last.select(*KEY, "block", "name", "slot", node_of().alias("node"))


def uses_of(rows: DataFrame) -> DataFrame:
    """project, module, id, name, slot, scopes: variables as terms, returns as uses of the result, super types as types."""
    terms = rows.where("kind IN ('Var', 'Return')").select(*KEY, "id", F.when(F.col("kind") == "Return", F.lit(RESULT)).otherwise(F.col("name")).alias("name"), F.lit("term").alias("slot"), "scopes")
    types = rows.where("kind IN ('Class', 'TypeAlias') AND value IS NOT NULL").select(*KEY, "id", F.explode(F.split("value", ",")).alias("name"), F.lit("type").alias("slot"), "scopes")
    return terms.union(types)


def resolve_names(rows: DataFrame, imports: DataFrame | None = None, library: DataFrame | None = None) -> DataFrame:
    """project, module, id, name, slot, target of every use.

    A name belongs to the innermost block around the use that defines it, then to
    imports(project, module, name, slot, target), then to library(name, slot, node),
    then to the basic types; else it is unknown.  Scopes are exploded, so all is one join.
    """
    uses = uses_of(rows)
    at = uses.select("*", F.posexplode("scopes").alias("depth", "block")).drop("scopes")
    found = at.join(shuffled(definitions_of(rows)), [*KEY, "block", "name", "slot"]).groupBy(*KEY, "id", "name", "slot").agg(F.max_by("node", "depth").alias("own"))
    out = uses.drop("scopes").join(shuffled(found), [*KEY, "id", "name", "slot"], "left")
    if imports is not None:
        out = out.join(shuffled(imports.select(*KEY, "name", "slot", F.col("target").alias("imported"))), [*KEY, "name", "slot"], "left")
    if library is not None:
        out = out.join(library.select("name", "slot", F.col("node").alias("known")), ["name", "slot"], "left")
    lit = F.lit(None).cast("string")
    ways = [F.col("own"), F.col("imported") if imports is not None else lit, F.col("known") if library is not None else lit, F.when(F.col("slot") == "type", basic_type(F.col("name")))]
    return out.select(*KEY, "id", "name", "slot", F.coalesce(*ways, F.concat(F.lit("unknown:"), F.col("name"))).alias("target"))


def collect_imports(rows: DataFrame, exports: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """project, module, name, slot, target of what import statements bring in.

    exports(project, module, symbol, slot, node); the symbol default is a module's
    default export.  Paths that start with a dot are relative to the importing
    module; others may be renamed by aliases(path, module).  A module imported as a
    whole is the namespace module:path.  What no module exports is unknown.
    """
    asked = rows.where("kind = 'Import'").select(*KEY, F.col("name").alias("symbol"), F.col("alias").alias("as_name"), resolved_path(F.col("module"), F.col("path")).alias("from_module"))
    if aliases is not None:
        asked = asked.join(aliases.select(F.col("path").alias("p"), F.col("module").alias("m")), F.col("from_module") == F.col("p"), "left").withColumn("from_module", F.coalesce("m", "from_module")).drop("p", "m")
    whole = asked.where("symbol = '*'").select(*KEY, F.col("as_name").alias("name"), F.explode(F.array(F.lit("term"), F.lit("namespace"))).alias("slot"), F.concat(F.lit("module:"), "from_module").alias("target"))
    given = exports.select(F.col("project").alias("ep"), F.col("module").alias("em"), F.col("symbol").alias("es"), "slot", "node")
    match = (F.col("project") == F.col("ep")) & (F.col("from_module") == F.col("em")) & (F.col("symbol") == F.col("es"))
    single = asked.where("symbol <> '*'").join(shuffled(given), match, "left")
    unknown = F.concat(F.lit("unknown:"), "from_module", F.lit("/"), "symbol")
    return whole.union(single.select(*KEY, F.col("as_name").alias("name"), F.coalesce("slot", F.lit("term")).alias("slot"), F.coalesce("node", unknown).alias("target")))


def resolved_path(module: Column, path: Column) -> Column:
    """A module path: relative ones from the folder of the module, with . and .. taken out."""
    folder = F.slice(F.split(module, "/"), F.lit(1), F.greatest(F.size(F.split(module, "/")) - 1, F.lit(0)))
    parts = F.when(F.startswith(path, F.lit(".")), F.concat(folder, F.split(path, "/"))).otherwise(F.split(path, "/"))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when((p == ".") | (p == ""), done).when((p == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.array_join(walked, "/")


def collect_exports(rows: DataFrame) -> DataFrame:
    """project, module, symbol, slot, node: what a module exports by itself.

    Definitions at the top with export or export default, and export statements
    without a path, under their new names.  `export *` and exports from other
    modules are links between modules, see `export_links`.
    """
    top = definitions_of(rows).where("block = 0")
    marked = rows.where("block = 0 AND exported IS NOT NULL").select(*KEY, "name", "exported").distinct()
    direct = top.join(shuffled(marked), [*KEY, "name"]).select(*KEY, F.explode(F.when(F.col("exported") == "default", F.array("name", F.lit("default"))).otherwise(F.array("name"))).alias("symbol"), "slot", "node")
    named = rows.where("kind = 'Export' AND path IS NULL AND name IS NOT NULL AND name <> '*'").select(*KEY, "name", F.col("alias").alias("symbol"))
    return direct.union(named.join(shuffled(top), [*KEY, "name"]).select(*KEY, "symbol", "slot", "node")).distinct()


def export_links(rows: DataFrame) -> DataFrame:
    """project, module, from_module, old, new: exports of what other modules export; * and * for all."""
    return rows.where("kind = 'Export' AND path IS NOT NULL").select(*KEY, resolved_path(F.col("module"), F.col("path")).alias("from_module"), F.coalesce("name", F.lit("default")).alias("old"), F.col("alias").alias("new"))


def linked_exports(rows: DataFrame, rounds: int | None = None) -> DataFrame:
    """collect_exports with what comes through export_links, through chains of any length (or so many rounds).

    A module's own export wins over one that it passes on, a link by name over
    `*`; defaults do not pass through `*`.
    """
    return passed_on(collect_exports(rows), export_links(rows), rounds)


def passed_on(own: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """own(project, module, symbol, slot, node) with what links(project, module, from_module, old, new) pass on, as `linked_exports` says.

    A round passes on only what the last one has found or bettered; what is known is written once.
    """
    spark, export = own.sparkSession, [*KEY, "symbol", "slot"]
    kept = Stored(spark, "exports")
    links = kept.put("links", links)
    star = F.col("old") == "*"
    best = lambda df: df.groupBy(*export).agg(F.min(F.struct("rank", "node")).alias("b"))
    known = new = kept.put("0", best(own.withColumn("rank", F.lit(0))))
    done = 0
    while rounds is None or done < rounds:
        done += 1
        given = new.select(F.col("project").alias("p"), F.col("module").alias("m"), "symbol", "slot", "b.node")
        of_module = (F.col("project") == F.col("p")) & (F.col("from_module") == F.col("m"))
        all_ = links.where(star).join(shuffled(given.where("symbol <> 'default'")), of_module).select(*KEY, "symbol", "slot", "node", F.lit(2).alias("rank"))
        named = links.where(~star).join(shuffled(given), of_module & (F.col("old") == F.col("symbol"))).select(*KEY, F.col("new").alias("symbol"), "slot", "node", F.lit(1).alias("rank"))
        before = known.select(*[F.col(c).alias(f"_{c}") for c in export], F.col("b").alias("_b"))
        better = best(named.union(all_)).join(shuffled(before), [*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in export], F.col("_b") <= F.col("b")], "left_anti")
        new = kept.put(str(done), better)
        release(spark)
        if new.isEmpty():
            break
        known = known.union(new)
    return best(known.select(*export, "b.rank", "b.node")).select(*export, "b.node")


def lower_statements(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """project, module, id, kind, v, rhs, rhs2, cond, type_node, args: flat statements, as `lowering` takes them.

    Every expression is a variable of its own, named by its node; variables stand
    for what they resolve to, constants for the library term of their type.
    Children come to their parent by one grouping.  Comments, imports, exports and
    blocks leave no statement; namespaces are flattened.
    """
    targets = resolved.where("slot = 'term'").select(*KEY, "id", "target")
    constant = F.when(F.col("kind") == "Const", F.coalesce(basic_type(F.col("type")), F.concat(F.lit("lib:"), "type")))
    valued = rows.join(shuffled(targets), [*KEY, "id"], "left").withColumn("v", F.coalesce(F.when(F.col("kind") == "Var", F.col("target")), constant, node_of()))
    child = F.struct("role", "pos", "name", F.col("v").alias("node"))
    children = valued.where("parent IS NOT NULL AND kind NOT IN ('Block', 'Comment', 'Import', 'Export')").groupBy(*KEY, F.col("parent").alias("id")).agg(F.sort_array(F.collect_list(child)).alias("kids"))
    full = valued.join(shuffled(children), [*KEY, "id"], "left")
    one = lambda role: F.element_at(F.filter("kids", lambda k: k["role"] == role), 1)["node"]
    several = lambda test, label: F.transform(F.filter("kids", test), lambda k: F.struct(label(k).alias("label"), k["node"].alias("arg")))
    position = lambda k: k["pos"].cast("string")
    kind = F.col("kind")
    no_args = F.lit(None).cast("array<struct<label:string,arg:string>>")
    args = (
        F.when(kind == "Call", F.concat(several(lambda k: k["role"] == "func", lambda k: F.lit("func")), several(lambda k: k["role"] == "arg", position)))
        .when(kind == "Object", several(lambda k: F.startswith(k["role"], F.lit("field:")), lambda k: F.substring(k["role"], F.lit(7), F.length(k["role"]))))
        .when(kind == "Access", several(lambda k: k["role"] == "object", lambda k: F.col("name")))
        .when(kind == "FuncDef", F.concat(several(lambda k: k["role"] == "result", lambda k: F.lit("result")), several(lambda k: k["role"] == "arg", position)))
        .when(kind == "Class", several(lambda k: k["role"].isin("field", "method"), lambda k: k["name"]))
        .otherwise(no_args)
    )
    v = F.when(kind == "Assign", one("lhs")).when(kind == "Return", F.col("target")).when(kind.isin("If", "While"), F.lit(None)).otherwise(F.col("v"))
    rhs = F.when(kind == "VarDef", one("init")).when(kind == "Assign", one("rhs")).when(kind.isin("Return", "Cast"), one("expr")).when(kind == "IfExpr", one("then"))
    cond = F.when(kind.isin("If", "While", "IfExpr"), one("cond"))
    stated = F.when(kind == "Cast", F.coalesce(basic_type(F.col("type")), F.concat(F.lit("type:"), "type")))
    flat = full.select(*KEY, "id", kind.alias("was"), v.alias("v"), rhs.alias("rhs"), F.when(kind == "IfExpr", one("else")).alias("rhs2"), cond.alias("cond"), stated.alias("type_node"), args.alias("args"))
    kept = flat.where("was IN ('VarDef', 'Assign', 'Return', 'If', 'While', 'Call', 'Object', 'Access', 'IfExpr', 'Cast', 'FuncDef', 'Class')")
    # a class and each of its super types
    supers = resolved.where("slot = 'type'").groupBy(*KEY, "id").agg(F.sort_array(F.collect_list("target")).alias("supers"))
    out = kept.join(shuffled(supers), [*KEY, "id"], "left").withColumn("rhs", F.explode_outer(F.when(F.col("was") == "Class", F.col("supers")).otherwise(F.array("rhs"))))
    named = F.when(F.col("was") == "Class", "ClassDef").otherwise(F.col("was"))
    return out.select(*KEY, "id", named.alias("kind"), "v", "rhs", "rhs2", "cond", "type_node", "args")
