"""From flat statements to relations, and the text grammars of imports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a statement (kind, v, rhs, rhs2, cond, type_node, args) relates: (kind of statement, category, left, right).
RELATIONS = [
    ("VarDef", "equal", "v", "rhs"), ("Cast", "subtype", "rhs", "v"), ("Cast", "fixType", "v", "type_node"), ("Assign", "assign", "v", "rhs"), ("Return", "assign", "v", "rhs"),
    ("IfExpr", "subtype", "rhs", "v"), ("IfExpr", "subtype", "rhs2", "v"), ("ClassDef", "inheritance", "v", "rhs"),
]
CONDITIONS = ("IfExpr", "If", "While")
DEFINITIONS = {"Call": "call", "Object": "object", "Access": "access", "FuncDef": "func", "ClassDef": "object"}


def relations(statements: DataFrame) -> DataFrame:
    """lhs, rhs, category: without self loops and repeats."""
    pairs = F.array(*[F.when(F.col("kind") == kind, F.struct(F.col(a).alias("lhs"), F.col(b).alias("rhs"), F.lit(category).alias("category"))) for kind, category, a, b in RELATIONS])
    return statements.select(F.explode(F.array_compact(pairs)).alias("r")).select("r.*").where("lhs IS NOT NULL AND rhs IS NOT NULL AND lhs <> rhs").distinct()


def conditions(statements: DataFrame) -> DataFrame:
    """node: everything that is used as a condition."""
    return statements.where(F.col("kind").isin(*CONDITIONS) & F.col("cond").isNotNull()).select(F.col("cond").alias("node")).distinct()


def definitions(statements: DataFrame) -> DataFrame:
    """node, define, pos, label, arg: one row for each argument, field or result of a definition."""
    define = F.coalesce(*[F.when(F.col("kind") == k, F.lit(d)) for k, d in DEFINITIONS.items()])
    return statements.select(F.col("v").alias("node"), define.alias("define"), F.posexplode("args").alias("pos", "a")).where("define IS NOT NULL").select("node", "define", "pos", "a.label", "a.arg")


def substitute(edges: DataFrame, merged: DataFrame, columns: list[str]) -> DataFrame:
    """edges with every node replaced by what merged(node, component) says."""
    for c in columns:
        m = merged.select(F.col("node").alias("_node"), F.col("component").alias("_new"))
        edges = edges.join(m, F.col(c) == F.col("_node"), "left").withColumn(c, F.coalesce("_new", c)).drop("_node", "_new")
    return edges.distinct()


def _member(part: Column) -> Column:
    names = F.split(F.trim(part), r"\s+as\s+")
    return F.struct(F.element_at(names, 1).alias("name"), F.element_at(names, -1).alias("alias"))


def parse_import(text: Column) -> Column:
    """Array of (kind, path, name, alias) of an import statement: default, module, single, require, none."""
    path = F.regexp_extract(text, r"""['"]([^'"]*)['"]""", 1)
    entry = lambda kind, name, alias: F.struct(F.lit(kind).alias("kind"), path.alias("path"), name.alias("name"), alias.alias("alias"))
    null = F.lit(None).cast("string")
    clause = F.regexp_extract(text, r"(?s)^\s*import\s+(.*?)\s*from\s", 1)
    braces = F.regexp_extract(clause, r"(?s)\{(.*)\}", 1)
    outside = F.trim(F.regexp_replace(F.regexp_replace(clause, r"(?s)\{.*\}", ""), r"[,\s]+$", ""))
    star = F.regexp_extract(outside, r"\*\s+as\s+([A-Za-z0-9_$]+)", 1)
    default = F.regexp_extract(outside, r"^([A-Za-z0-9_$]+)", 1)
    members = F.filter(F.split(braces, ","), lambda p: F.trim(p) != "")
    singles = F.transform(members, lambda p: F.struct(F.lit("single").alias("kind"), path.alias("path"), _member(p)["name"].alias("name"), _member(p)["alias"].alias("alias")))
    required = F.regexp_extract(text, r"^\s*import\s+([A-Za-z0-9_$]+)\s*=\s*require", 1)
    maybe = lambda cond, e: F.when(cond, F.array(e)).otherwise(F.array().cast("array<struct<kind:string,path:string,name:string,alias:string>>"))
    found = F.concat(maybe(default != "", entry("default", F.lit("default"), default)), maybe(star != "", entry("module", F.lit("*"), star)), singles, maybe(required != "", entry("require", F.lit("*"), required)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(entry("none", null, null)))


def parse_export(text: Column) -> Column:
    """Array of (kind, path, name, alias) of an export statement: default, all, single, namespace."""
    path = F.nullif(F.regexp_extract(text, r"""from\s+['"]([^'"]*)['"]""", 1), F.lit(""))
    braces = F.regexp_extract(text, r"(?s)^\s*export\s*\{(.*?)\}", 1)
    default = F.regexp_extract(text, r"^\s*export\s+default\s+([A-Za-z0-9_$.]+)", 1)
    space = F.regexp_extract(text, r"^\s*export\s+as\s+namespace\s+([A-Za-z0-9_$]+)", 1)
    entry = lambda kind, name, alias: F.struct(F.lit(kind).alias("kind"), path.alias("path"), name.alias("name"), alias.alias("alias"))
    members = F.filter(F.split(braces, ","), lambda p: F.trim(p) != "")
    singles = F.transform(members, lambda p: F.struct(F.lit("single").alias("kind"), path.alias("path"), _member(p)["name"].alias("name"), _member(p)["alias"].alias("alias")))
    return (
        F.when(default != "", F.array(entry("default", default, F.lit("default"))))
        .when(space != "", F.array(entry("namespace", space, space)))
        .when(F.rlike(text, F.lit(r"^\s*export\s*\*")), F.array(entry("all", F.lit("*"), F.lit("*"))))
        .otherwise(singles)
    )


def type_texts(types: DataFrame, children: DataFrame) -> DataFrame:
    """type_id, text: `any`, a name, `(a,b)->c`, `{l: t, m: u}`; for types that do not contain themselves."""
    from .graph import checkpointed

    leaf = types.where("kind IN ('any', 'var')").select("type_id", F.coalesce("name", F.lit("any")).alias("text"))
    done = leaf
    composite = types.where("kind IN ('func', 'object')").select("type_id", "kind")
    while True:  # one level of nesting in each round
        known = done.select(F.col("type_id").alias("child"), "text")
        rows = composite.join(done.select("type_id"), "type_id", "left_anti").join(children, "type_id").join(known, "child", "left")
        ready = rows.groupBy("type_id", "kind").agg(F.count_if(F.col("text").isNull()).alias("open"), F.sort_array(F.collect_list(F.struct("pos", "label", "text"))).alias("kids")).where("open = 0")
        args = F.array_join(F.transform(F.filter("kids", lambda k: k["pos"] >= 0), lambda k: k["text"]), ",")
        result = F.element_at(F.transform(F.filter("kids", lambda k: k["pos"] < 0), lambda k: k["text"]), 1)
        fields = F.array_join(F.transform("kids", lambda k: F.concat(k["label"], F.lit(": "), k["text"])), ", ")
        text = F.when(F.col("kind") == "func", F.concat(F.lit("("), args, F.lit(")->"), result)).otherwise(F.concat(F.lit("{"), fields, F.lit("}")))
        new = checkpointed(done.union(ready.select("type_id", text.alias("text"))))
        if new.count() == done.count():
            return done
        done = new
