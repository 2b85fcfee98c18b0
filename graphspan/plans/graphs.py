"""Program-graph queries over the mapped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, messages
from ..operators.order import numbered
from ..sources.tables import Tables, binary_relations, nodes
from .registry import query

NODES = """nodes AS (SELECT 'r:' || r_regionkey AS node, true AS is_type, true AS from_lib, r_name AS name FROM region UNION ALL SELECT 'n:' || n_nationkey, true, true, n_name FROM nation
UNION ALL SELECT 'c:' || c_custkey, true, false, c_name FROM customer UNION ALL SELECT 's:' || s_suppkey, true, false, s_name FROM supplier)"""
RELS = """rels AS (SELECT 'n:' || n_nationkey AS lhs, 'r:' || n_regionkey AS rhs, 'inheritance' AS category FROM nation UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'subtype' FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'equal' FROM supplier UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'assign' FROM orders)"""


@query(f"WITH {RELS} SELECT category AS kind, count(*) * 2 AS messages, count(DISTINCT rhs) AS targets FROM rels WHERE lhs <> rhs GROUP BY 1")
def message_batches(t: Tables) -> DataFrame:
    """Messages of each kind; both directions count."""
    rels = binary_relations(t)
    counts = messages.binary_messages(rels).groupBy("kind").agg(F.count("*").alias("messages"))
    return counts.join(rels.groupBy(F.col("category").alias("kind")).agg(F.countDistinct("rhs").alias("targets")), "kind")


@query(f"""WITH {NODES}, {RELS}, m AS (SELECT lhs AS dst, rhs AS src FROM rels UNION ALL SELECT rhs, lhs FROM rels), l AS (SELECT node FROM nodes WHERE from_lib)
SELECT dst AS node, count(*) AS degree FROM m WHERE NOT (dst IN (SELECT node FROM l) AND src IN (SELECT node FROM l)) GROUP BY 1""")
def degree_counts(t: Tables) -> DataFrame:
    kept = messages.drop_library_messages(messages.binary_messages(binary_relations(t)), nodes(t).where("from_lib"))
    return kept.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("degree"))


@query("""SELECT l_linenumber AS label, count(DISTINCT l_orderkey) AS classes, count(DISTINCT l_partkey) AS accesses FROM lineitem GROUP BY 1""")
def label_usages(t: Tables) -> DataFrame:
    """Fields by label: how many classes have it, how many targets it has."""
    return t.lineitem.groupBy(F.col("l_linenumber").alias("label")).agg(F.countDistinct("l_orderkey").alias("classes"), F.countDistinct("l_partkey").alias("accesses"))


@query("""SELECT o_orderkey, l_linenumber AS field, p_partkey AS callee, s_nationkey AS result FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderpriority = '1-URGENT' AND p_size < 20""")
def method_call_chain(t: Tables) -> DataFrame:
    """call - access - object - field - signature as a chain of equi-joins."""
    calls = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    chain = calls.join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t.part.where("p_size < 20").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return chain.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("o_orderkey", F.col("l_linenumber").alias("field"), F.col("p_partkey").alias("callee"), F.col("s_nationkey").alias("result"))


@query("""SELECT c_custkey, coalesce(s_name, CASE WHEN c_nationkey < 20 THEN n_name END) AS signature FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE coalesce(s_name, CASE WHEN c_nationkey < 20 THEN n_name END) IS NOT NULL""")
def signature_coalesce(t: Tables) -> DataFrame:
    """The first of two lookups that finds something."""
    found = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return found.select("c_custkey", F.coalesce("s_name", F.when(F.col("c_nationkey") < 20, F.col("n_name"))).alias("signature")).where("signature IS NOT NULL")


CONSTRAINTS = f"""{RELS}, constraints AS (SELECT DISTINCT child, parent FROM (SELECT lhs AS child, rhs AS parent FROM rels WHERE category IN ('subtype', 'inheritance', 'equal')
UNION ALL SELECT rhs, lhs FROM rels WHERE category IN ('assign', 'equal')))"""


def constraints(t: Tables) -> DataFrame:
    """child, parent pairs that the relations demand: assignments run right to left, equalities both ways."""
    down = F.struct(F.col("lhs").alias("child"), F.col("rhs").alias("parent"))
    up = F.struct(F.col("rhs").alias("child"), F.col("lhs").alias("parent"))
    both = F.when(F.col("category") == "equal", F.array(down, up)).when(F.col("category") == "assign", F.array(up)).otherwise(F.array(down))
    return binary_relations(t).select(F.explode(both).alias("c")).select("c.*").distinct()


@query(f"WITH {CONSTRAINTS} SELECT child, parent FROM constraints")
def subtype_constraints(t: Tables) -> DataFrame:
    return constraints(t)


@query(f"""WITH {CONSTRAINTS}, a AS (SELECT 'r:' || r_regionkey AS node, r_regionkey AS ty FROM region UNION ALL SELECT 'n:' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 's:' || s_suppkey, (s_suppkey % 5)::INT FROM supplier)
SELECT child, parent FROM constraints JOIN a x ON child = x.node JOIN a y ON parent = y.node WHERE x.ty <> y.ty""")
def violations(t: Tables) -> DataFrame:
    """Constraints that an assignment of types breaks."""
    a = (
        t.region.select(F.concat(F.lit("r:"), "r_regionkey").alias("node"), F.col("r_regionkey").alias("ty"))
        .union(t.nation.select(F.concat(F.lit("n:"), "n_nationkey"), "n_regionkey"))
        .union(t.supplier.select(F.concat(F.lit("s:"), "s_suppkey"), (F.col("s_suppkey") % 5).cast("int")))
    )
    x, y = a.select(F.col("node").alias("child"), F.col("ty").alias("tx")), a.select(F.col("node").alias("parent"), F.col("ty").alias("ty"))
    return constraints(t).join(x, "child").join(y, "parent").where("tx <> ty").select("child", "parent")


@query("""WITH RECURSIVE k AS (SELECT p_partkey AS a, p_brand || p_type || p_size AS b FROM part), w AS (SELECT a, 'k' || b AS b FROM k),
e AS (SELECT x.a AS a, y.a AS b FROM w x JOIN w y USING (b)), c AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node)
SELECT node, min(root) AS component FROM c GROUP BY node""")
def equality_components(t: Tables) -> DataFrame:
    """Parts of equal brand, type and size as one node: each is linked to the least of its group."""
    key = ["p_brand", "p_type", "p_size"]
    least = t.part.groupBy(*key).agg(F.min("p_partkey").alias("b"))
    edges = t.part.join(least, key).select(F.col("p_partkey").alias("a"), "b")
    return graph.equality_components(edges)


@query(f"""WITH RECURSIVE {RELS}, r AS (SELECT 'r:1' AS node UNION SELECT lhs FROM r JOIN rels ON rhs = node) SELECT node FROM r""")
def reachable_nodes(t: Tables) -> DataFrame:
    """Everything that leads to the region 1."""
    edges = binary_relations(t).select(F.col("rhs").alias("src"), F.col("lhs").alias("dst"))
    return graph.reachable(edges, t.spark.createDataFrame([("r:1",)], "node string")).select("node")


@query(f"""WITH RECURSIVE {RELS}, s AS (SELECT lhs AS a, rhs AS b FROM rels UNION SELECT rhs, lhs FROM rels), h AS (SELECT 'r:' || r_regionkey AS node, 0 AS hops FROM region UNION SELECT b, hops + 1 FROM h JOIN s ON a = node WHERE hops < 4)
SELECT node, min(hops)::INT AS hops FROM h GROUP BY node""")
def hop_distance(t: Tables) -> DataFrame:
    """Least number of hops from any region."""
    edges = binary_relations(t).select(F.col("lhs").alias("src"), F.col("rhs").alias("dst"))
    seeds = t.region.select(F.concat(F.lit("r:"), "r_regionkey").alias("node"))
    return graph.reachable(edges, seeds, undirected=True)


@query(f"""WITH RECURSIVE {RELS}, l AS (SELECT DISTINCT lhs AS node, 0 AS level FROM rels WHERE lhs NOT IN (SELECT rhs FROM rels) UNION SELECT rhs, level + 1 FROM l JOIN rels ON lhs = node)
SELECT node, max(level)::INT AS level FROM l GROUP BY node""")
def topo_levels(t: Tables) -> DataFrame:
    return graph.topological_levels(binary_relations(t).select(F.col("lhs").alias("src"), F.col("rhs").alias("dst")))


@query("""WITH RECURSIVE own AS (SELECT host AS module, seg AS symbol, min(url) AS origin FROM (SELECT url, split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(split_part(url, '://', 2), '/', 2) AS seg FROM pages) GROUP BY 1, 2),
e AS (SELECT * FROM own UNION SELECT p.parent, e.symbol, e.origin FROM e, LATERAL (SELECT regexp_replace(e.module, '^[^.]*\\.', '') AS parent) p
WHERE p.parent <> e.module AND p.parent LIKE '%.%' AND NOT EXISTS (SELECT 1 FROM own o WHERE o.module = p.parent AND o.symbol = e.symbol))
SELECT module, symbol, max(origin) AS origin FROM e WHERE module NOT IN (SELECT module FROM own) GROUP BY 1, 2""".replace("\\\\", "\\"))
def exports_fixpoint(t: Tables) -> DataFrame:
    """Hosts export first path segments; a parent domain re-exports its children's.  Rows of the parents."""
    after = F.element_at(F.split("url", "://"), 2)
    own = t.pages.select("url", F.split(after, "/").alias("p")).select(F.col("p")[0].alias("module"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("symbol"), "url").groupBy("module", "symbol").agg(F.min("url").alias("origin"))
    up = F.regexp_replace("module", r"^[^.]*\.", "")
    chain = own.select("module").distinct()
    links = None
    while not chain.isEmpty():  # one label less in each round
        step = chain.select(up.alias("parent"), F.col("module").alias("from_module")).where("parent <> from_module AND instr(parent, '.') > 0").distinct()
        links = step if links is None else links.union(step).distinct()
        chain = graph.checkpointed(step.select(F.col("parent").alias("module")))
    if links is None:
        links = own.select(F.col("module").alias("parent"), F.col("module").alias("from_module")).where("false")
    out = graph.resolve_exports(own, links.select(F.col("parent").alias("module"), "from_module"))
    return out.join(own.select("module").distinct(), "module", "left_anti")


@query("""WITH p AS (SELECT page_id, split_part(url, '://', 2) AS path FROM pages), a AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix, 'h' || length(split_part(path, '/', 1)) AS target FROM p
UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 'two' FROM p WHERE split_part(path, '/', 2) = 'en'),
m AS (SELECT page_id, path, arg_max(target, length(prefix)) AS target FROM p JOIN a ON path = prefix OR starts_with(path, prefix || '/') GROUP BY 1, 2) SELECT page_id, target FROM m""")
def prefix_alias(t: Tables) -> DataFrame:
    """Paths by their longest alias."""
    paths = t.pages.select("page_id", F.element_at(F.split("url", "://"), 2).alias("path"))
    parts = F.split("path", "/")
    one = paths.select(parts[0].alias("prefix")).distinct().withColumn("target", F.concat(F.lit("h"), F.length("prefix")))
    two = paths.where(F.get(parts, F.lit(1)) == "en").select(F.concat_ws("/", parts[0], parts[1]).alias("prefix")).distinct().withColumn("target", F.lit("two"))
    return graph.longest_prefix(paths, one.union(two)).where("target IS NOT NULL").select("page_id", "target")


@query("""SELECT page_id, CASE WHEN url LIKE '%/' THEN url[1:length(url) - 1] ELSE url END AS path FROM pages UNION ALL SELECT page_id, url FROM pages WHERE url LIKE '%/'""")
def index_link(t: Tables) -> DataFrame:
    """Folder pages under both of their names."""
    folder = F.endswith("url", F.lit("/"))
    short = t.pages.select("page_id", F.when(folder, F.expr("substring(url, 1, length(url) - 1)")).otherwise(F.col("url")).alias("path"))
    return short.union(t.pages.where(folder).select("page_id", "url"))


@query("""SELECT DISTINCT a.l_orderkey AS node, list_sort(list(DISTINCT a.l_linenumber))::VARCHAR AS labels FROM lineitem a GROUP BY 1""")
def object_labels(t: Tables) -> DataFrame:
    """All labels of each object."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("node")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_set("l_linenumber")), ", "), F.lit("]")).alias("labels"))


@query(f"WITH {NODES} SELECT node, row_number() OVER (ORDER BY from_lib DESC, node)::INT - 1 AS idx FROM nodes WHERE is_type")
def prediction_space_index(t: Tables) -> DataFrame:
    """Library types first, numbered range by range of the order."""
    return numbered(nodes(t).where("is_type").select("node", "from_lib"), [F.desc("from_lib"), F.asc("node")], "idx").select("node", F.col("idx").cast("int"))


@query("""SELECT 'digraph ' || r_name || ' {' || string_agg(n_name, '; ' ORDER BY n_nationkey) || '}' AS text FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name""")
def graph_text(t: Tables) -> DataFrame:
    rows = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "; ").alias("names"))
    return rows.select(F.concat(F.lit("digraph "), "r_name", F.lit(" {"), "names", F.lit("}")).alias("text"))


@query("""SELECT l_orderkey, '<p>' || string_agg('<span class="' || CASE WHEN l_returnflag = 'R' THEN 'correct' WHEN l_returnflag = 'A' THEN 'incorrect' ELSE 'missing' END || '">' || l_partkey || '</span>', '' ORDER BY l_linenumber, l_partkey, l_returnflag) || '</p>' AS html FROM lineitem GROUP BY 1""")
def html_render(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "correct").when(F.col("l_returnflag") == "A", "incorrect").otherwise("missing")
    span = F.concat(F.lit('<span class="'), kind, F.lit('">'), F.col("l_partkey").cast("string"), F.lit("</span>"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", span.alias("s")))), lambda x: x["s"]), "").alias("body"))
    return rows.select("l_orderkey", F.concat(F.lit("<p>"), "body", F.lit("</p>")).alias("html"))
