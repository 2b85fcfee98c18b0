"""The lattice of types as nested values, and folds of it over ordered rows.

A type is a tuple: ("any",), ("var", name), ("func", (argument, ..), result) or
("object", ((label, type), ..)) with labels in order.  As a column it is text in
one canonical form, so equal types are equal strings: any, a name, (a,b)->c and
{l: t, m: u}.  Nesting has no limit but memory.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = ("any",)


def from_json(value: dict) -> tuple:
    """The type that a JSON syntax tree describes."""
    kind = value["category"]
    if kind == "AnyType" or kind == "TVar" and value["name"] == "any":
        return ANY
    if kind == "TVar":
        return "var", value["name"]
    if kind == "FuncType":
        return "func", tuple(from_json(a) for a in value.get("args") or []), from_json(value["to"])
    if kind == "ObjectType":
        return object_type({f["name"]: from_json(f["value"]) for f in value.get("fields") or []})
    raise ValueError(f"unknown type: {kind}")


def object_type(fields: dict[str, tuple]) -> tuple:
    return "object", tuple(sorted(fields.items()))


def to_text(t: tuple) -> str:
    if t[0] == "func":
        return f"({','.join(map(to_text, t[1]))})->{to_text(t[2])}"
    if t[0] == "object":
        return "{" + ", ".join(f"{label}: {to_text(x)}" for label, x in t[1]) + "}"
    return t[-1]


def from_text(text: str) -> tuple:
    """The inverse of to_text."""
    at = 0

    def take(mark: str) -> bool:
        nonlocal at
        if text.startswith(mark, at):
            at += len(mark)
            return True
        return False

    def name(stops: str) -> str:
        nonlocal at
        start = at
        while at < len(text) and text[at] not in stops:
            at += 1
        return text[start:at]

    def one() -> tuple:
        if take("("):
            args = []
            while not take(")"):
                args.append(one())
                take(",")
            if not take("->"):
                raise ValueError(f"a result is missing: {text}")
            return "func", tuple(args), one()
        if take("{"):
            fields = {}
            while not take("}"):
                label = name(":")
                take(": ")
                fields[label] = one()
                take(", ")
            return object_type(fields)
        word = name(",)}")
        return ANY if word == "any" else ("var", word)

    found = one()
    if at != len(text):
        raise ValueError(f"not a type: {text}")
    return found


def meet(a: tuple, b: tuple) -> tuple:
    """What is left of two types that describe one thing.

    any gives the other one; equal variables stay; functions are joined argument
    by argument, the shorter list filled up with any; objects have the fields of
    both; everything else becomes any.
    """
    if a == ANY or b == ANY:
        return b if a == ANY else a
    if a[0] == b[0] == "func":
        long = max(len(a[1]), len(b[1]))
        x, y = (t[1] + (ANY,) * (long - len(t[1])) for t in (a, b))
        return "func", tuple(map(meet, x, y)), meet(a[2], b[2])
    if a[0] == b[0] == "object":
        return merge_objects(a, b)
    return a if a == b else ANY


def merge_objects(a: tuple, b: tuple, overlap: bool = True) -> tuple:
    """Fields of both objects; without overlap, a label in both is an error."""
    x, y = dict(a[1]), dict(b[1])
    if not overlap and x.keys() & y.keys():
        raise ValueError(f"fields in both: {sorted(x.keys() & y.keys())}")
    return object_type({k: meet(x.get(k, ANY), y.get(k, ANY)) for k in x.keys() | y.keys()})


def meet_all(types: Iterable[tuple]) -> tuple:
    """meet from left to right; the order matters, as any is both the neutral type and that of a conflict."""
    out = ANY
    for t in types:
        out = meet(out, t)
    return out


def substitute(t: tuple, names: dict[str, tuple]) -> tuple:
    """The type with variables replaced."""
    if t[0] == "var":
        return names.get(t[1], t)
    if t[0] == "func":
        return "func", tuple(substitute(a, names) for a in t[1]), substitute(t[2], names)
    if t[0] == "object":
        return "object", tuple((label, substitute(x, names)) for label, x in t[1])
    return t


def monotype(t: tuple, variables: set[str]) -> tuple:
    """The type with type parameters erased to any."""
    return substitute(t, dict.fromkeys(variables, ANY))


def parts(t: tuple) -> Iterable[tuple[str | None, int, tuple]]:
    """(label, position, type) directly inside a type; the result of a function stands at -1."""
    if t[0] == "func":
        yield from ((None, i, a) for i, a in enumerate(t[1]))
        yield None, -1, t[2]
    elif t[0] == "object":
        yield from ((label, i, x) for i, (label, x) in enumerate(t[1]))


def names_of(t: tuple) -> set[str]:
    return {t[1]} if t[0] == "var" else set().union(*(names_of(x) for _, _, x in parts(t)), set())


def labels_of(t: tuple) -> set[str]:
    own = {label for label, _, _ in parts(t) if label is not None}
    return own.union(*(labels_of(x) for _, _, x in parts(t)))


def size_of(t: tuple) -> int:
    return 1 + sum(size_of(x) for _, _, x in parts(t))


def meet_text(a: Column, b: Column) -> Column:
    """meet of two columns of types; null counts as any."""
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([to_text(meet(from_text(x or "any"), from_text(y or "any"))) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(a, b)


#: Texts and folds that a worker remembers: the same few come again and again.
REMEMBERED = 50_000


@lru_cache(REMEMBERED)
def read_text(text: str) -> tuple:
    return from_text(text)


@lru_cache(REMEMBERED)
def met_text(texts: tuple[str | None, ...]) -> str:
    """meet_all of types as texts; null counts as any."""
    return to_text(meet_all(read_text(t or "any") for t in texts))


def merged_types(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """key, type: the types of a key's rows met in order.  A key's types come to one task, as their order decides."""
    @F.pandas_udf("string")
    def fold(types: pd.Series) -> pd.Series:
        return pd.Series([met_text(tuple(x)) for x in types], dtype=object)

    ordered = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, column))), lambda x: x[column]).alias("types"))
    return ordered.select(key, fold("types").alias("type"))


def hash_consed(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(types, children) of all types in a column and inside them, each once: type_id is the canonical text.

    types(type_id, kind, name), children(type_id, pos, label, child) as the
    operators over type tables take them.
    """
    @F.pandas_udf("array<struct<type_id:string,kind:string,name:string,children:array<struct<pos:int,label:string,child:string>>>>")
    def opened(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found, todo = {}, [from_text(text)] if text else []
            while todo:
                t = todo.pop()
                if (key := to_text(t)) not in found:
                    inside = list(parts(t))
                    found[key] = {"type_id": key, "kind": t[0], "name": t[1] if t[0] == "var" else None, "children": [{"pos": i, "label": label, "child": to_text(x)} for label, i, x in inside]}
                    todo += [x for _, _, x in inside]
            out.append(list(found.values()))
        return pd.Series(out)

    nodes = rows.select(column).distinct().select(F.explode(opened(F.col(column))).alias("t")).select("t.*").dropDuplicates(["type_id"])
    return nodes.select("type_id", "kind", "name"), nodes.select("type_id", F.explode("children").alias("c")).select("type_id", "c.*")


def random_type(rng, names: list[str], size: int) -> tuple:
    """A type of about so many nodes, for tests: leaves are any or a name."""
    if size <= 1:
        return ANY if rng.random() < 0.2 else ("var", names[rng.randrange(len(names))])
    n = rng.randint(1, min(3, size - 1))
    inner = [random_type(rng, names, (size - 1) // n) for _ in range(n)]
    if rng.random() < 0.5:
        return "func", tuple(inner[:-1]), inner[-1]
    return object_type(dict(zip("xyz", inner, strict=False)))


def type_text_column(json: Column) -> Column:
    """Canonical text of a JSON type; null stays null."""
    import json as reader

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else to_text(from_json(reader.loads(t))) for t in texts], dtype=object)

    return read(json)
