"""Statements to relations, imports, merging, pruning, layers, tensors, evaluation grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import blocks, graph, layers, lowering
from ..sources.tables import Tables, binary_relations, nodes
from .graphs import NODES, RELS
from .registry import query
from .vectors import DIM, EMB, elements, whole


def statements(t: Tables) -> DataFrame:
    """Order data as statements: an order is a variable and an object, its lines are accesses, big orders are conditions."""
    args = "array<struct<label:string,arg:string>>"
    null = lambda kind="string": F.lit(None).cast(kind)
    row = lambda df, kind, v, rhs=None, rhs2=None, cond=None, ty=None, a=None: df.select(F.lit(kind).alias("kind"), v.alias("v"), (null() if rhs is None else rhs).alias("rhs"), (null() if rhs2 is None else rhs2).alias("rhs2"), (null() if cond is None else cond).alias("cond"), (null() if ty is None else ty).alias("type_node"), (null(args) if a is None else a).alias("args"))
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    fields = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.struct(x["l_linenumber"].cast("string").alias("label"), F.concat(F.lit("p:"), x["l_partkey"].cast("string")).alias("arg"))).alias("fields"))
    return (
        row(t.orders, "VarDef", tag("o:", "o_orderkey"), tag("c:", "o_custkey"))
        .union(row(t.orders.where("o_totalprice > 200000"), "If", tag("o:", "o_orderkey"), cond=tag("c:", "o_custkey")))
        .union(row(t.lineitem.where("l_returnflag = 'R'"), "Cast", tag("l:", "l_orderkey"), tag("p:", "l_partkey"), ty=tag("s:", "l_suppkey")))
        .union(row(t.lineitem.where("l_returnflag = 'A'"), "IfExpr", tag("l:", "l_orderkey"), tag("p:", "l_partkey"), tag("s:", "l_suppkey"), cond=tag("o:", "l_orderkey")))
        .union(row(fields, "Object", tag("o:", "l_orderkey"), a=F.col("fields")))
    )


@query("""SELECT DISTINCT lhs, rhs, category FROM (SELECT 'o:' || o_orderkey AS lhs, 'c:' || o_custkey AS rhs, 'equal' AS category FROM orders
UNION ALL SELECT 'p:' || l_partkey, 'l:' || l_orderkey, 'subtype' FROM lineitem WHERE l_returnflag IN ('R', 'A') UNION ALL SELECT 'l:' || l_orderkey, 's:' || l_suppkey, 'fixType' FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 's:' || l_suppkey, 'l:' || l_orderkey, 'subtype' FROM lineitem WHERE l_returnflag = 'A')""")
def encode_statements(t: Tables) -> DataFrame:
    return lowering.relations(statements(t))


@query("""SELECT DISTINCT node FROM (SELECT 'c:' || o_custkey AS node FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'o:' || l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def used_as_bool(t: Tables) -> DataFrame:
    return lowering.conditions(statements(t))


@query("""SELECT 'o:' || l_orderkey AS node, 'object' AS define, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INT AS pos, l_linenumber::VARCHAR AS label, 'p:' || l_partkey AS arg FROM lineitem""")
def define_relations(t: Tables) -> DataFrame:
    return lowering.definitions(statements(t))


#: Forms of statements; # stands for the number of a page.
IMPORTS = [
    "import A# from './a#';", "import * as B# from \"lib/b#\";", "import {c#} from 'c#'", "import { d# as e#, f#, } from './d#'", "import G#, {h#} from 'g#'", "import 'side/effect#';", "import K# = require('k#');",
]
EXPORTS = ["export default Main#;", "export {a#, b# as c#}", "export * from './x#'", "export {d#} from \"y#\"", "export as namespace N#;"]


def page_statements(t: Tables, forms: list[str]) -> DataFrame:
    """page_id, text: a statement for every page, in turns of the forms."""
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("page_id") % len(forms)).cast("int") + 1)
    return t.pages.select("page_id", F.replace(form, F.lit("#"), F.col("page_id").cast("string")).alias("text"))


@query("""WITH v AS (SELECT * FROM (VALUES (0, 'default', './a#', 'default', 'A#'), (1, 'module', 'lib/b#', '*', 'B#'), (2, 'single', 'c#', 'c#', 'c#'), (3, 'single', './d#', 'd#', 'e#'), (3, 'single', './d#', 'f#', 'f#'),
(4, 'default', 'g#', 'default', 'G#'), (4, 'single', 'g#', 'h#', 'h#'), (5, 'none', 'side/effect#', NULL, NULL), (6, 'require', 'k#', '*', 'K#')) v(i, kind, path, name, alias))
SELECT page_id, kind, replace(path, '#', page_id::VARCHAR) AS path, replace(name, '#', page_id::VARCHAR) AS name, replace(alias, '#', page_id::VARCHAR) AS alias FROM pages JOIN v ON page_id % 7 = i""")
def import_patterns(t: Tables) -> DataFrame:
    return page_statements(t, IMPORTS).select("page_id", F.explode(lowering.parse_import(F.col("text"))).alias("e")).select("page_id", "e.*")


@query("""WITH v AS (SELECT * FROM (VALUES (0, 'default', NULL, 'Main#', 'default'), (1, 'single', NULL, 'a#', 'a#'), (1, 'single', NULL, 'b#', 'c#'), (2, 'all', './x#', '*', '*'), (3, 'single', 'y#', 'd#', 'd#'), (4, 'namespace', NULL, 'N#', 'N#')) v(i, kind, path, name, alias))
SELECT page_id, kind, replace(path, '#', page_id::VARCHAR) AS path, replace(name, '#', page_id::VARCHAR) AS name, replace(alias, '#', page_id::VARCHAR) AS alias FROM pages JOIN v ON page_id % 5 = i""")
def export_patterns(t: Tables) -> DataFrame:
    return page_statements(t, EXPORTS).select("page_id", F.explode(lowering.parse_export(F.col("text"))).alias("e")).select("page_id", "e.*")


@query("""WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS root FROM part) SELECT DISTINCT l_orderkey, root AS l_partkey FROM lineitem JOIN m ON l_partkey = p_partkey""")
def merge_equalities(t: Tables) -> DataFrame:
    """Order lines after parts of equal brand, type and size have become one node."""
    key = ["p_brand", "p_type", "p_size"]
    edges = t.part.join(t.part.groupBy(*key).agg(F.min("p_partkey").alias("b")), key).select(F.col("p_partkey").alias("a"), "b")
    return lowering.substitute(t.lineitem.select("l_orderkey", "l_partkey"), graph.equality_components(edges), ["l_partkey"])


@query(f"""WITH RECURSIVE {NODES}, {RELS}, s AS (SELECT lhs AS a, rhs AS b FROM rels UNION SELECT rhs, lhs FROM rels), lib AS (SELECT node FROM nodes WHERE from_lib),
r AS (SELECT 'c:' || c_custkey AS node FROM customer WHERE c_acctbal < 0 UNION SELECT b FROM r JOIN s ON a = node WHERE node NOT IN (SELECT node FROM lib)) SELECT node FROM r""")
def prune_graph(t: Tables) -> DataFrame:
    """What the needed nodes (customers in debt) reach, without walking through library nodes."""
    edges = binary_relations(t).select(F.col("lhs").alias("src"), F.col("rhs").alias("dst"))
    seeds = t.customer.where("c_acctbal < 0").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.reachable(edges, seeds, nodes(t).where("from_lib"), undirected=True).select("node")


@query(f"""WITH {EMB} SELECT vec_id, round(list_sum(v), 6) AS sum, round(list_avg(v), 6) AS mean, round(log10(abs(list_product(v))), 5) AS prod_digits, round(list_max(v), 6) AS max, round(list_min(v), 6) AS min,
(list_position(v, list_max(v)) - 1)::INT AS argmax, (list_position(v, list_min(v)) - 1)::INT AS argmin, round(list_avg(list_transform(v, lambda x: x * x)) - list_avg(v) * list_avg(v), 6) AS variance FROM emb""")
def tensor_reductions(t: Tables) -> DataFrame:
    v = F.col("v")
    mean = V.total(v) / F.size(v)
    place = lambda x: (F.array_position(v, x) - 1).cast("int")
    prod = F.aggregate(v, F.lit(1.0), lambda a, x: a * x)
    return whole(t).select("vec_id", F.round(V.total(v), 6).alias("sum"), F.round(mean, 6).alias("mean"), F.round(F.log10(F.abs(prod)), 5).alias("prod_digits"), F.round(F.array_max(v), 6).alias("max"), F.round(F.array_min(v), 6).alias("min"), place(F.array_max(v)).alias("argmax"), place(F.array_min(v)).alias("argmin"), F.round(V.dot(v, v) / F.size(v) - mean * mean, 6).alias("variance"))


@query(f"""WITH {EMB} SELECT vec_id, (i - 1)::INT AS i, round(v[i] + v[{DIM} + 1 - i], 6) AS plus, round(v[i] * v[{DIM} + 1 - i], 6) AS times, round(greatest(v[i], v[{DIM} + 1 - i]), 6) AS maximum, v[i] > v[{DIM} + 1 - i] AS greater FROM emb, range(1, {DIM} + 1) r(i)""")
def tensor_binary(t: Tables) -> DataFrame:
    """Element-wise operations of a vector and its reverse."""
    pairs = F.zip_with("v", F.reverse("v"), lambda a, b: F.struct(F.round(a + b, 6).alias("plus"), F.round(a * b, 6).alias("times"), F.round(F.greatest(a, b), 6).alias("maximum"), (a > b).alias("greater")))
    return whole(t).select("vec_id", F.posexplode(pairs).alias("i", "p")).select("vec_id", "i", "p.*")


@query(f"""WITH {EMB}, x AS (SELECT vec_id, label, i, v[i + 1] AS a FROM emb, range({DIM}) r(i)) SELECT x.i::INT AS i, y.i::INT AS j, round(sum(x.a * y.a), 5) AS dot FROM x JOIN x y USING (vec_id) GROUP BY 1, 2""")
def matrix_dot(t: Tables) -> DataFrame:
    """A matrix, transposed, times itself: a product for each batch of rows where they lie, summed before the shuffle."""
    return blocks.gram(whole(t), "v").select("i", "j", F.round("dot", 5).alias("dot"))


WEIGHTS = layers.seeded_weights("linear", 3, DIM)


@query(f"WITH {EMB} SELECT vec_id, " + ", ".join(f"round(0.1 + {' + '.join(f'v[{j + 1}] * ({w})::DOUBLE' for j, w in enumerate(row))}, 5) AS y{k}" for k, row in enumerate(WEIGHTS)) + " FROM emb")
def linear_layer(t: Tables) -> DataFrame:
    y = layers.linear(F.col("v"), WEIGHTS, [0.1] * 3)
    return whole(t).select("vec_id", y.alias("y")).select("vec_id", *[F.round(F.element_at("y", k + 1), 5).alias(f"y{k}") for k in range(3)])


@query("""WITH m AS (SELECT avg(value) AS m, var_pop(value) AS v FROM events) SELECT event_id, round((value - m) / sqrt(v + 1e-5), 6) AS value FROM events, m""")
def batch_norm(t: Tables) -> DataFrame:
    return layers.batch_norm(t.events.select("event_id", "value"), "value").select("event_id", F.round("value", 6).alias("value"))


@query(f"""WITH {EMB} SELECT vec_id, (i - 1)::INT AS i, round(CASE WHEN ('0x' || substr(md5('1|' || vec_id || '|' || (i - 1)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.9 THEN v[i] / 0.9 ELSE 0 END, 6) AS x FROM emb, range(1, {DIM} + 1) r(i)""")
def dropout(t: Tables) -> DataFrame:
    kept = layers.dropout(F.col("v"), F.col("vec_id"), 0.9)
    return elements(whole(t).select("vec_id", kept.alias("kept")), "kept", "vec_id", digits=6)


@query("""WITH RECURSIVE c AS (SELECT conv_id, length(text) / 1000.0::DOUBLE AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
g AS (SELECT conv_id, 0::BIGINT AS i, 0.0::DOUBLE AS h FROM c WHERE i = 1 UNION ALL SELECT g.conv_id, c.i,
(1 - 1 / (1 + exp(-(c.x * 0.5 + g.h * 0.3)))) * g.h + 1 / (1 + exp(-(c.x * 0.5 + g.h * 0.3))) * tanh(c.x * 0.8 + 1 / (1 + exp(-(c.x * -0.2 + g.h * 0.4))) * g.h * 0.6) FROM g JOIN c ON c.conv_id = g.conv_id AND c.i = g.i + 1)
SELECT conv_id, round(arg_max(h, i), 6) AS state FROM g GROUP BY 1""")
def gru_state(t: Tables) -> DataFrame:
    cell = layers.Gru({"wz": [[0.5]], "uz": [[0.3]], "wr": [[-0.2]], "ur": [[0.4]], "wh": [[0.8]], "uh": [[0.6]]})
    return layers.recurrent(_turns(t), "conv_id", "turn", "x", cell).select("conv_id", F.round(F.col("state")[0], 6).alias("state"))


def _turns(t: Tables) -> DataFrame:
    """Turns of a conversation as vectors of one element: thousands of characters."""
    return t.conversations.select("conv_id", "turn", F.array(F.length("text") / 1000.0).alias("x"))


SIGMOID = "1 / (1 + exp(-({})))"


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, length(text) / 1000.0::DOUBLE AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
g AS (SELECT conv_id, 0::BIGINT AS i, 0.0::DOUBLE AS h, 0.0::DOUBLE AS c FROM c WHERE i = 1 UNION ALL SELECT conv_id, i, o * tanh(c), c FROM (
SELECT g.conv_id, c.i, {SIGMOID.format("c.x * 0.5 + g.h * 0.4")} AS o, {SIGMOID.format("c.x * 0.2 + g.h * 0.1 + 1")} * g.c + {SIGMOID.format("c.x * 0.7 - g.h * 0.3")} * tanh(c.x * 0.9 + g.h * 0.6) AS c FROM g JOIN c ON c.conv_id = g.conv_id AND c.i = g.i + 1))
SELECT conv_id, round(arg_max(h, i), 6) AS state FROM g GROUP BY 1""")
def lstm_state(t: Tables) -> DataFrame:
    cell = layers.Lstm({"wi": [[0.7]], "ui": [[-0.3]], "wf": [[0.2]], "uf": [[0.1]], "wo": [[0.5]], "uo": [[0.4]], "wg": [[0.9]], "ug": [[0.6]]})
    return layers.recurrent(_turns(t), "conv_id", "turn", "x", cell).select("conv_id", F.round(F.col("state")[0], 6).alias("state"))


def _gru_sql(order: str) -> str:
    return f"""SELECT conv_id, turn, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn {order}) AS i FROM turns"""


@query(f"""WITH RECURSIVE turns AS (SELECT conv_id, turn, length(text) / 1000.0::DOUBLE AS x FROM conversations), a AS ({_gru_sql("")}), b AS ({_gru_sql("DESC")}),
f AS (SELECT conv_id, 0::BIGINT AS turn, 0::BIGINT AS i, 0.0::DOUBLE AS h FROM a WHERE i = 1 UNION ALL SELECT f.conv_id, a.turn, a.i, (1 - {SIGMOID.format("a.x * 0.5 + f.h * 0.3")}) * f.h + {SIGMOID.format("a.x * 0.5 + f.h * 0.3")} * tanh(a.x * 0.8 + {SIGMOID.format("a.x * -0.2 + f.h * 0.4")} * f.h * 0.6) FROM f JOIN a ON a.conv_id = f.conv_id AND a.i = f.i + 1),
r AS (SELECT conv_id, 0::BIGINT AS turn, 0::BIGINT AS i, 0.0::DOUBLE AS h FROM b WHERE i = 1 UNION ALL SELECT r.conv_id, b.turn, b.i, (1 - {SIGMOID.format("b.x * 0.5 + r.h * 0.3")}) * r.h + {SIGMOID.format("b.x * 0.5 + r.h * 0.3")} * tanh(b.x * 0.8 + {SIGMOID.format("b.x * -0.2 + r.h * 0.4")} * r.h * 0.6) FROM r JOIN b ON b.conv_id = r.conv_id AND b.i = r.i + 1)
SELECT f.conv_id, f.turn, round(f.h, 6) AS forward, round(r.h, 6) AS backward FROM f JOIN r ON f.conv_id = r.conv_id AND f.turn = r.turn WHERE f.i > 0 AND r.i > 0""")
def bidirectional_gru(t: Tables) -> DataFrame:
    weights = {"wz": [[0.5]], "uz": [[0.3]], "wr": [[-0.2]], "ur": [[0.4]], "wh": [[0.8]], "uh": [[0.6]]}
    out = layers.bidirectional(_turns(t), "conv_id", "turn", "x", layers.Gru(weights), layers.Gru(weights))
    return out.select("conv_id", "turn", F.round(F.col("state")[0], 6).alias("forward"), F.round(F.col("state")[1], 6).alias("backward"))


@query("""WITH RECURSIVE d AS (SELECT day(ts)::INT AS batch, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY batch) AS i FROM d),
r AS (SELECT 0::INT AS batch, 0::BIGINT AS i, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS variance UNION ALL SELECT o.batch, o.i, mean * 0.9 + m * (1 - 0.9::DOUBLE), variance * 0.9 + v * (1 - 0.9::DOUBLE) FROM r JOIN o ON o.i = r.i + 1)
SELECT batch, round(mean, 6) AS mean, round(variance, 4) AS variance FROM r WHERE i > 0""")
def batch_norm_moments(t: Tables) -> DataFrame:
    """Moving moments over days as batches."""
    rows = t.events.select(F.dayofmonth("ts").alias("batch"), "value")
    return layers.running_moments(rows, "batch", "value").select("batch", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("""SELECT p_partkey, i::INT AS i, round(CASE WHEN i % 2 = 0 THEN sin((p_size - 1) / pow(10000.0, (i - i % 2) / 8.0::DOUBLE)) ELSE cos((p_size - 1) / pow(10000.0, (i - i % 2) / 8.0::DOUBLE)) END, 6) AS x FROM part, range(8) r(i)""")
def position_encoding(t: Tables) -> DataFrame:
    return elements(t.part.select("p_partkey", layers.encode_position(F.col("p_size") - 1, 8).alias("v")), "v", "p_partkey", digits=6)


@query("""WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag)::INT AS rank FROM c) SELECT l_suppkey, l_returnflag, n, rank FROM r""")
def constructor_frequency_rank(t: Tables) -> DataFrame:
    """Types of a project by how often their constructor is called."""
    counts = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "l_returnflag")))


@query("""WITH g AS (SELECT ratio, rep FROM (VALUES (0.0), (0.2), (0.4), (0.6), (0.8), (0.9)) a(ratio), range(3) b(rep)),
h AS (SELECT ratio, rep, o_orderstatus, o_orderpriority, ('0x' || substr(md5(rep || '|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE < ratio AS kept FROM g, orders)
SELECT round(ratio, 1)::DOUBLE AS ratio, rep::INT AS rep, count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS correct FROM h WHERE NOT kept GROUP BY 1, 2""")
def evaluation_grid(t: Tables) -> DataFrame:
    """Accuracy over what is left to predict when a share of the annotations is given, for shares and repeats.

    The grid has 18 rows; each order meets all of them.
    """
    grid = F.array(*[F.struct(F.lit(r).alias("ratio"), F.lit(k).alias("rep")) for r in (0.0, 0.2, 0.4, 0.6, 0.8, 0.9) for k in range(3)])
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.explode(grid).alias("g")).select("o_orderkey", "o_orderstatus", "g.*")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col("o_orderkey").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.where(~(draw < F.col("ratio"))).groupBy("ratio", "rep").agg(F.count("*").alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("correct"))


@query("""WITH p AS (SELECT DISTINCT regexp_replace(split_part(url, '://', 2), '[?#].*$', '') AS path FROM pages), q AS (SELECT DISTINCT split_part(path, '/', 1) AS scope, 1 AS depth FROM p UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 2 FROM p WHERE split_part(path, '/', 2) IN ('en', 'de')),
m AS (SELECT path, scope, row_number() OVER (PARTITION BY path ORDER BY depth DESC) AS r FROM p JOIN q ON path = scope OR starts_with(path, scope || '/')) SELECT path, scope FROM m WHERE r = 1""")
def nearest_scope(t: Tables) -> DataFrame:
    """The innermost enclosing scope that defines anything."""
    paths = t.pages.select(F.regexp_replace(F.element_at(F.split("url", "://"), 2), r"[?#].*$", "").alias("path")).distinct()
    parts = F.split("path", "/")
    outer = paths.select(parts[0].alias("prefix")).distinct()
    inner = paths.where(F.get(parts, F.lit(1)).isin("en", "de")).select(F.concat_ws("/", parts[0], parts[1]).alias("prefix")).distinct()
    scopes = outer.union(inner).withColumn("target", F.col("prefix"))
    return graph.longest_prefix(paths, scopes).select("path", F.col("target").alias("scope"))


@query("""SELECT l_partkey AS dep, count(DISTINCT l_orderkey) AS repos FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 10""")
def dependency_counts(t: Tables) -> DataFrame:
    """Dependencies by how many projects have them."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("dep")).agg(F.countDistinct("l_orderkey").alias("repos")).where("repos >= 10")


@query("""SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45)""")
def dependencies_available(t: Tables) -> DataFrame:
    """Projects all of whose dependencies are available."""
    missing = t.lineitem.join(t.part.where("p_size > 45"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey")
    return t.lineitem.select("l_orderkey").distinct().join(missing, "l_orderkey", "left_anti")


@query(f"""WITH {EMB}, e AS (SELECT vec_id % 100 AS grp, i, exp(v[i + 1] - list_max(v)) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS p FROM emb, range({DIM}) r(i)),
s AS (SELECT grp, i, round(sum(p), 6) AS p FROM e GROUP BY 1, 2) SELECT grp, arg_max(i, (p, -i))::INT AS cls FROM s GROUP BY 1""")
def grouped_accuracy_argmax(t: Tables) -> DataFrame:
    """Class of a group of rows: their softmax rows summed, then the best."""
    top = F.array_max("v")
    e = F.transform("v", lambda x: F.exp(x - top))
    rows = whole(t).select((F.col("vec_id") % 100).alias("grp"), e.alias("e")).select("grp", F.posexplode(F.transform("e", lambda x: x / V.total(F.col("e")))).alias("i", "p"))
    sums = rows.groupBy("grp", "i").agg(F.round(F.sum("p"), 6).alias("p"))
    return sums.groupBy("grp").agg(F.max_by("i", F.struct("p", -F.col("i"))).alias("cls"))
