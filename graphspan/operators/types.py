"""Types as hash-consed rows, and consistent subtyping as a table of pairs.

types(type_id, kind, name) has kinds any, var, func and object; children(type_id,
pos, label, child) has the arguments of a function in order and its result at
-1, and the fields of an object by label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed


def subtype_pairs(types: DataFrame, children: DataFrame) -> DataFrame:
    """child, parent: all pairs that are consistent subtypes.

    Greatest fixpoint: all pairs start true and those that a rule refutes are
    taken away until none is left.  any goes with everything; variables with
    themselves; functions of equal arity have contravariant arguments and
    covariant results; objects have at least the parent's fields, each a subtype.
    """
    arity = children.groupBy("type_id").agg(F.count("*").alias("n"))
    t = types.join(arity, "type_id", "left").fillna(0, ["n"])
    side = lambda p: t.select(*[F.col(c).alias(f"{p}_{c}") for c in ("type_id", "kind", "name", "n")])
    # types of one kind only can be related, but for any
    same = side("c").join(side("p"), F.col("c_kind") == F.col("p_kind"))
    with_any = side("c").where("c_kind = 'any'").join(side("p").where("p_kind <> 'any'")).union(side("c").where("c_kind <> 'any'").join(side("p").where("p_kind = 'any'")))
    shape = "c_kind = 'any' OR c_kind = 'var' AND c_name = p_name OR c_kind = 'func' AND c_n = p_n OR c_kind = 'object'"
    pairs = checkpointed(same.where(shape).union(with_any).select(F.col("c_type_id").alias("child"), F.col("p_type_id").alias("parent"), F.col("c_kind").alias("ck"), F.col("p_kind").alias("pk")))
    kids = lambda p: children.select(*[F.col(c).alias(f"{p}_{c}") for c in ("type_id", "pos", "label", "child")])
    funcs = pairs.where("ck = 'func' AND pk = 'func'").join(kids("c"), F.col("child") == F.col("c_type_id")).join(kids("p"), (F.col("parent") == F.col("p_type_id")) & (F.col("c_pos") == F.col("p_pos")))
    needs_f = funcs.select("child", "parent", F.when(F.col("c_pos") < 0, F.col("c_child")).otherwise(F.col("p_child")).alias("a"), F.when(F.col("c_pos") < 0, F.col("p_child")).otherwise(F.col("c_child")).alias("b"))
    fields = pairs.where("ck = 'object' AND pk = 'object'").join(kids("p"), F.col("parent") == F.col("p_type_id")).join(kids("c"), (F.col("child") == F.col("c_type_id")) & (F.col("c_label") == F.col("p_label")), "left")
    needs_o = fields.select("child", "parent", F.col("c_child").alias("a"), F.col("p_child").alias("b"))
    needs = checkpointed(needs_f.union(needs_o))
    pairs = pairs.select("child", "parent")
    while True:
        known = pairs.select(F.col("child").alias("a"), F.col("parent").alias("b"), F.lit(True).alias("ok"))
        refuted = needs.join(known, ["a", "b"], "left").where("ok IS NULL").select("child", "parent").distinct()
        left = checkpointed(pairs.join(refuted, ["child", "parent"], "left_anti"))
        if left.count() == pairs.count():
            return left
        pairs = left


def nongenerify(types: DataFrame) -> DataFrame:
    """type_id and the type that prediction uses: functions become the variable Function, objects any."""
    return types.select("type_id", F.expr("CASE kind WHEN 'func' THEN 'Function' WHEN 'object' THEN 'any' WHEN 'any' THEN 'any' ELSE name END").alias("target"))


def ast_sizes(types: DataFrame, children: DataFrame) -> DataFrame:
    """type_id, size: nodes of the type's tree, for types of any depth that do not contain themselves."""
    sizes = types.join(children.select("type_id").distinct(), "type_id", "left_anti").select("type_id", F.lit(1).cast("long").alias("size"))
    while True:  # one level of nesting in each round
        done = sizes.select(F.col("type_id").alias("child"), "size")
        ready = children.join(sizes.select("type_id"), "type_id", "left_anti").join(done, "child", "left").groupBy("type_id").agg((F.sum("size") + 1).alias("size"), F.count_if(F.col("size").isNull()).alias("open")).where("open = 0")
        new = checkpointed(sizes.union(ready.select("type_id", "size")))
        if new.count() == sizes.count():
            return sizes
        sizes = new
