import math

import pandas as pd
from graphspan.functions import names, scalars, vectors
from graphspan.operators import order, dataset, graph, messages, ranking, search, types
from graphspan.sources import json_ast
from pyspark.sql import functions as F


def segments(spark, *words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", names.segment_name(F.col("w")).alias("s")).collect()
    return {r.w: r.s for r in rows}


def test_segment_name(spark):
    got = segments(spark, "parseHTMLText", "snake_case2Name", "PlusToken", "$scope", "$Switch", "", "___", "a1b")
    assert got["parseHTMLText"] == ["parse", "html", "text"]
    assert got["snake_case2Name"] == ["snake", "case", "name"]
    assert got["PlusToken"] == ["PlusToken"]
    assert got["$scope"] == ["$scope"]
    assert got["$Switch"] == ["$switch"]
    assert got[""] == [] and got["___"] == []
    assert got["a1b"] == ["a", "b"] or got["a1b"] == ["a"] or got["a1b"] == ["ab"]


def test_select_by_frequency(spark):
    counts = spark.createDataFrame([("a", 50), ("b", 30), ("c", 15), ("d", 5), ("e", 1)], "k string, n bigint")
    keep = lambda **a: {r.k for r in names.select_by_frequency(counts, "k", "n", **a).collect()}
    assert keep(coverage=0.8) == {"a", "b"}
    assert keep(coverage=0.81) == {"a", "b", "c"}
    assert keep(coverage=0.1, at_least=3) == {"a", "b", "c"}
    assert "e" not in keep(coverage=1.0)


def test_accuracy_of_nothing_is_one(spark):
    assert spark.range(1).select(scalars.accuracy(F.lit(0), F.lit(0)).alias("x")).first().x == 1.0


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.digits(F.lit(0).cast("long"), 10).alias("zero"), scalars.digits(F.lit(1203).cast("long"), 10).alias("d"), scalars.pretty_time(F.lit(1_500_000).cast("long")).alias("t"), scalars.wrap_in_range(F.lit(-1), 5).alias("w")
    ).first()
    assert row.zero == [0] and row.d == [1, 2, 0, 3] and row.t == "1.500ms" and row.w == 4


def test_cosine_of_zero_is_null(spark):
    v = F.array(F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(vectors.cosine(v, v).alias("c")).first().c is None


def test_components_of_chains_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 9), (9, 7), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.component for r in graph.equality_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5}


def test_reachable_ends_on_cycles_and_does_not_leave_stops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.hops for r in graph.reachable(edges, seeds).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    stop = spark.createDataFrame([("c",)], "node string")
    assert {r.node for r in graph.reachable(edges, seeds, stop).collect()} == {"a", "b", "c"}


def test_exports_pass_through_chains_and_own_ones_win(spark):
    own = spark.createDataFrame([("a", "x", "a.x"), ("b", "y", "b.y"), ("c", "x", "c.x")], "module string, symbol string, origin string")
    rex = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "missing")], "module string, from_module string")
    got = {(r.module, r.symbol): r.origin for r in graph.resolve_exports(own, rex).collect()}
    assert got[("b", "x")] == "a.x" and got[("c", "x")] == "c.x" and got[("d", "x")] == "c.x" and got[("d", "y")] == "b.y"


def test_longest_prefix(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",)], "path string")
    aliases = spark.createDataFrame([("a", "1"), ("a/b", "2")], "prefix string, target string")
    assert {r.path: r.target for r in graph.longest_prefix(paths, aliases).collect()} == {"a/b/c": "2", "a/x": "1", "z": None}


def point_context(spark):
    """A small context of types: points in two and three dimensions, comparators, types that contain themselves, any."""
    kinds = [("any", "any", None), ("int", "var", "int"), ("number", "var", "number"), ("string", "var", "string"), ("p2", "object", None), ("p3", "object", None), ("p2s", "object", None), ("cmp", "func", None), ("cmp_any", "func", None), ("cmp3", "func", None), ("node", "object", None), ("loop", "object", None)]
    kids = [
        ("p2", 0, "x", "int"), ("p2", 1, "y", "int"), ("p3", 0, "x", "int"), ("p3", 1, "y", "int"), ("p3", 2, "z", "int"), ("p2s", 0, "x", "string"), ("p2s", 1, "y", "int"),
        ("cmp", 0, None, "p2"), ("cmp", -1, None, "int"), ("cmp_any", 0, None, "any"), ("cmp_any", -1, None, "int"), ("cmp3", 0, None, "p3"), ("cmp3", -1, None, "int"),
        ("node", 0, "next", "node"), ("node", 1, "value", "int"), ("loop", 0, "next", "node"),
    ]
    return spark.createDataFrame(kinds, "type_id string, kind string, name string"), spark.createDataFrame(kids, "type_id string, pos int, label string, child string")


def test_subtyping(spark):
    pairs = {(r.child, r.parent) for r in types.subtype_pairs(*point_context(spark)).collect()}
    assert ("p3", "p2") in pairs and ("p2", "p3") not in pairs and ("p2s", "p2") not in pairs
    assert ("any", "p2") in pairs and ("p2", "any") in pairs
    assert ("cmp", "cmp3") in pairs and ("cmp3", "cmp") not in pairs  # arguments are contravariant
    assert ("node", "loop") in pairs and ("loop", "node") not in pairs and ("node", "node") in pairs


def test_patch_any_covers_all_pairs(spark):
    pairs = [(1, 2), (1, 4), (4, 3), (1, 3), (2, 3)]
    rows = spark.createDataFrame([("p", a, b) for a, b in pairs], "project string, a bigint, b bigint")
    cover = {r.node for r in search.patch_any(rows).collect()}
    assert all(a in cover or b in cover for a, b in pairs)
    weighted, left = search.weighted_patch_any({1: 4.0, 2: 3.0, 3: 5.0, 4: 3.0}, [(1, 2), (1, 4), (4, 3), (1, 3), (2, 3)])
    assert all(a in weighted or b in weighted for a, b in pairs)


def agreement(spark, how):
    proposals = spark.createDataFrame([("p", n, t, p) for n in range(4) for t, p in (("A", 0.5 if n % 2 else 0.4), ("B", 0.4 if n % 2 else 0.5))], "project string, node bigint, type_id string, prob double")
    bonds = spark.createDataFrame([("p", n, n + 1) for n in range(3)], "project string, a bigint, b bigint")
    first, second = (sorted(map(tuple, how(proposals, bonds).collect())) for _ in range(2))
    assert first == second
    return {t for _, _, t in first}


def test_searches_agree_and_repeat(spark):
    assert len(agreement(spark, search.anneal)) == 1
    assert len(agreement(spark, search.cross_entropy_search)) == 1


def project_of(seed, nodes=5):
    import random

    import pandas as pd

    rng = random.Random(seed)
    rows = [(n, t, rng.random()) for n in range(nodes) for t in ("A", "B", "any")]
    total = {n: sum(p for m, _, p in rows if m == n) for n in range(nodes)}
    proposals = pd.DataFrame([(n, t, p / total[n]) for n, t, p in rows], columns=["node", "type_id", "prob"])
    bonds = pd.DataFrame([(a, b) for a in range(nodes) for b in range(nodes) if a != b and rng.random() < 0.4], columns=["a", "b"])
    return search.Project(proposals, bonds, frozenset({("A", "B")}))


def test_searches_against_all_assignments():
    """Corrections leave nothing violated, and searches come to the best of all assignments."""
    import itertools

    import numpy as np

    for seed in range(12):
        p = project_of(seed)
        every = [dict(zip(p.nodes, ts, strict=True)) for ts in itertools.product("A B any".split(), repeat=len(p.nodes))]
        least = min(map(p.cost, every))
        rng = np.random.default_rng(seed)
        for neighbour, correction, reboot in (("one", "none", False), ("weighted", "any", True), ("wrong_first", "weighted", False), ("one", "local", True)):
            state, trace = p.anneal(rng, 400, 1.0, neighbour, correction, reboot)
            assert len(trace) == 400 and all(a[2] >= b[2] for a, b in itertools.pairwise(trace))
            assert p.cost(state) <= min(p.cost(p.corrected(p.likeliest(), correction)), trace[0][2]) + 1e-9
            if correction in ("any", "weighted"):
                assert not p.violated(p.corrected(p.likeliest(), correction))
        assert abs(p.cost(p.beam(300)[0]) - least) < 1e-9 or not p.violated(p.beam(300)[0])
        drawn = [p.sample(rng, p.prob) for _ in range(30)]
        assert not any(p.violated(s) for s in drawn)
        best, rounds = p.cross_entropy(rng, 20, 60, 6, 0.5, 4)
        assert p.cost(best) <= min(map(p.cost, drawn)) * 1.2 + 1e-9 and rounds[-1][3] <= rounds[0][3]


def test_neighbours_change_one_node_and_weigh_the_way_back():
    import numpy as np

    rng = np.random.default_rng(1)
    p = project_of(3)
    for kind in ("one", "weighted", "wrong_first"):
        for _ in range(200):
            state = p.likeliest()
            node, t, ratio = p.neighbour(rng, state, kind)
            assert t != state[node] and t in p.prob[node]
            if kind == "weighted":
                old, new = p.prob[node][state[node]], p.prob[node][t]
                assert abs(ratio - (old / (1 - new)) / (new / (1 - old))) < 1e-9


def test_sampling_by_weight(spark):
    items = spark.createDataFrame([("k", 1, 0.1), ("k", 2, 0.4), ("k", 3, 0.3), ("k", 4, 0.1)], "k string, i int, w double")
    pick = lambda p: ranking.sample_by_weight(items, ["k"], "i", "w", F.lit(p)).first().i
    assert (pick(0.11 / 0.9), pick(0.1 / 0.9), pick(1.0 - 1e-9)) == (2, 1, 4)


def test_divide(spark):
    split = dataset.divide(spark.range(50).withColumnRenamed("id", "p"), "p", 10, 5).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"test": 10, "dev": 5, "train": 35}


def test_messages_have_no_self_loops_and_no_library_pairs(spark):
    rel = spark.createDataFrame([("a", "a", "x"), ("a", "b", "x"), ("b", "c", "x")], "lhs string, rhs string, category string")
    lib = spark.createDataFrame([("a",), ("b",)], "node string")
    got = {(r.dst, r.src) for r in messages.drop_library_messages(messages.binary_messages(rel), lib).collect()}
    assert got == {("b", "c"), ("c", "b")}


def test_adam(spark):
    rows = spark.createDataFrame([("k", i, g) for i, g in enumerate([1.0, -0.5, 2.0])], "k string, i int, g double")
    got = order.adam_moves(order.in_ranges(rows, "k", "i"), "k", "g", "string", 0.1).first().moved
    m = v = x = 0.0
    for t, g in enumerate([1.0, -0.5, 2.0], 1):
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.1 * (m / (1 - 0.9**t)) / (math.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert abs(got - x) < 1e-9


def test_json_modules(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"path": "a", "is_decl": false, "stmts": ["x",]}\n{"path": "a", "is_decl": false, "stmts": ["y"]}\n')
    assert [sorted(r.stmts) for r in json_ast.modules(spark, str(tmp_path)).collect()] == [["x", "y"]]
    assert [r[0] for r in spark.createDataFrame([("a/b.d.ts",), ("c.js",)], "p string").select(json_ast.remove_extension(F.col("p"))).collect()] == ["a/b", "c"]


def test_source_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.ts").write_text("no")
    (tmp_path / "a.d.ts").write_text("one\ntwo")
    rows = json_ast.source_files(spark, str(tmp_path)).toPandas()
    assert isinstance(rows, pd.DataFrame) and rows["loc"].tolist() == [2] and rows["is_decl"].tolist() == [True]


def test_subtypes_of_the_point_context(spark):
    """All pairs, as stated by hand: any with everything, wider objects below narrower ones, functions the other way in their arguments, types that contain themselves."""
    context = point_context(spark)
    names = [r.type_id for r in context[0].collect()]
    also = {("p3", "p2"), ("cmp", "cmp3"), ("cmp", "cmp_any"), ("cmp3", "cmp_any"), ("cmp_any", "cmp"), ("cmp_any", "cmp3"), ("node", "loop")}
    want = {(a, b) for a in names for b in names if a == b or "any" in (a, b)} | also
    assert {(r.child, r.parent) for r in types.subtype_pairs(*context).collect()} == want
    assert {r.type_id: r.size for r in types.ast_sizes(*context).collect()} == {"any": 1, "int": 1, "number": 1, "string": 1, "p2": 3, "p3": 4, "p2s": 3, "cmp": 5, "cmp_any": 3, "cmp3": 6}


def test_weighted_cover_of_each_project(spark):
    from graphspan.operators import search

    cost = {1: 4.0, 2: 3.0, 3: 5.0, 4: 3.0}
    rows = [(p, a, b, cost[a], cost[b]) for p in (1, 2) for a, b in [(1, 2), (1, 4), (3, 4), (1, 3), (2, 3)]]
    got = {(r.project, r.node): (r.left_over, r.covered) for r in search.weighted_cover(spark.createDataFrame(rows, "project int, a bigint, b bigint, cost_a double, cost_b double")).collect()}
    # in order: (1, 2) pays 3, (1, 3) pays 1, then 1 and 2 are paid for; (3, 4) pays 3
    assert got == {(p, n): x for p in (1, 2) for n, x in {1: (0.0, True), 2: (0.0, True), 3: (1.0, False), 4: (0.0, True)}.items()}
