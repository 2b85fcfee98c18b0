"""Splits, sampling, set operations, joins, search and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sampling_key
from ..operators import dataset, search
from ..operators.ranking import sample_by_weight
from ..sources.tables import Tables
from .registry import query


@query("""WITH h AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('1|' || c_custkey), c_custkey) AS i FROM customer) SELECT c_custkey, CASE WHEN i <= 60 THEN 'test' WHEN i <= 100 THEN 'dev' ELSE 'train' END AS split FROM h""")
def hash_split(t: Tables) -> DataFrame:
    return dataset.divide(t.customer.select("c_custkey"), "c_custkey", 60, 40)


@query("""WITH h AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('7|' || o_orderkey), o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM h WHERE i <= floor(n * 0.6)""")
def annots_split(t: Tables) -> DataFrame:
    return dataset.keep_fraction(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 0.6, 7)


@query("""WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS lib FROM orders), h AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, lib ORDER BY md5('3|' || o_orderkey), o_orderkey) AS i, sum((NOT lib)::INT) OVER (PARTITION BY o_custkey) AS proj FROM l)
SELECT o_custkey, o_orderkey FROM h WHERE NOT lib OR i <= floor(proj * 0.5)""")
def downsample_lib(t: Tables) -> DataFrame:
    """Library annotations are cut to half as many as the project's own."""
    rows = t.orders.select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("lib")).withColumn("h", sampling_key(3, F.col("o_orderkey")))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("o_custkey", "lib").orderBy("h", "o_orderkey"))).withColumn("proj", F.count_if(~F.col("lib")).over(Window.partitionBy("o_custkey")))
    return rows.where(~F.col("lib") | (F.col("i") <= F.floor(F.col("proj") * 0.5))).select("o_custkey", "o_orderkey")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS running, 0.5 * sum(l_quantity) OVER (PARTITION BY l_orderkey) AS goal FROM lineitem) SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM w WHERE running >= goal GROUP BY 1""")
def cumulative_sampling(t: Tables) -> DataFrame:
    return sample_by_weight(t.lineitem, ["l_orderkey"], "l_linenumber", "l_quantity", F.lit(0.5))


@query("""SELECT c_mktsegment AS project, count(DISTINCT c_custkey) AS nodes, count(o_orderkey) AS predicates, sum((o_orderstatus = 'F')::INT)::BIGINT AS lib_annots, sum((o_orderstatus <> 'F')::INT)::BIGINT AS proj_annots FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def repo_statistics(t: Tables) -> DataFrame:
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy(F.col("c_mktsegment").alias("project")).agg(F.countDistinct("c_custkey").alias("nodes"), F.count("o_orderkey").alias("predicates"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("lib_annots"), F.sum((F.col("o_orderstatus") != "F").cast("int")).alias("proj_annots"))


@query("""SELECT n_name AS project, CASE WHEN NOT nodes BETWEEN 5 AND 2000 THEN 'TooBigOrSmall' WHEN annots * 10 < preds THEN 'TooFewLabels' WHEN (annots - lib) * 10 < lib THEN 'TooFewProjectLabels' ELSE 'filteredRepos' END AS destination FROM
(SELECT n_name, count(DISTINCT c_custkey) AS nodes, count(*) AS preds, sum((o_totalprice > 100000)::INT) AS annots, sum((o_totalprice > 100000 AND o_orderstatus = 'F')::INT) AS lib FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY 1)""")
def route_projects(t: Tables) -> DataFrame:
    rows = t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
    dear = F.col("o_totalprice") > 100000
    p = rows.groupBy(F.col("n_name").alias("project")).agg(F.countDistinct("c_custkey").alias("nodes"), F.count("*").alias("preds"), F.count_if(dear).alias("annots"), F.count_if(dear & (F.col("o_orderstatus") == "F")).alias("lib"))
    return p.select("project", dataset.destination(F.col("nodes"), F.col("preds"), F.col("annots"), F.col("lib"), 5, 2000).alias("destination"))


@query("""SELECT o_custkey AS project, count(*) AS predicates FROM orders GROUP BY 1 HAVING count(*) <= 12""")
def project_filter(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("predicates")).where("predicates <= 12")


@query("""SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
def setops_union(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("""SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders""")
def setops_except(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).exceptAll(t.orders.select("o_custkey").distinct())


@query("""SELECT p_partkey AS k FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'""")
def setops_intersect(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("k")).intersect(t.lineitem.where("l_returnflag = 'R'").select("l_partkey"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)""")
def join_semi(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name").join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def join_anti(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def join_full_merge(t: Tables) -> DataFrame:
    """Keyed merge of two counters."""
    count = lambda df, c: df.select(F.col(c).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return count(t.customer, "c_nationkey").union(count(t.supplier, "s_nationkey")).groupBy("k").agg(F.sum("n").alias("n"))


PROPOSALS = """prop AS (SELECT l_orderkey AS project, l_linenumber AS node, l_returnflag AS ty, (1 + l_quantity) / (2 + sum(l_quantity) OVER (PARTITION BY l_orderkey)) AS prob FROM lineitem)"""


def _proposals(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    return t.lineitem.select(F.col("l_orderkey").alias("project"), F.col("l_linenumber").alias("node"), F.col("l_returnflag").alias("ty"), ((1 + F.col("l_quantity")) / (2 + F.sum("l_quantity").over(w))).alias("prob"))


@query(f"WITH {PROPOSALS} SELECT project, round(sum(-ln(prob)), 5) AS nll, round(avg(-ln(prob)), 5) AS mean_nll, round(-sum(prob), 5) AS hamming FROM prop GROUP BY 1")
def objectives(t: Tables) -> DataFrame:
    return _proposals(t).groupBy("project").agg(F.round(F.sum(-F.log("prob")), 5).alias("nll"), F.round(F.avg(-F.log("prob")), 5).alias("mean_nll"), F.round(-F.sum("prob"), 5).alias("hamming"))


@query(f"WITH {PROPOSALS}, e AS (SELECT project, row_number() OVER (ORDER BY sum(-ln(prob)), project) AS r FROM prop GROUP BY 1), f AS (SELECT ty, count(*)::DOUBLE AS n FROM prop WHERE project IN (SELECT project FROM e WHERE r <= 100) GROUP BY 1) SELECT ty, round(0.7 * (1.0::DOUBLE / 3) + 0.3 * n / sum(n) OVER (), 6) AS prob FROM f")
def elite_update(t: Tables) -> DataFrame:
    """The 100 projects of least cost are the elites; distributions move towards theirs."""
    p = _proposals(t)
    elite = p.groupBy("project").agg(F.sum(-F.log("prob")).alias("cost")).orderBy("cost", "project").limit(100).select("project")
    counts = p.join(F.broadcast(elite), "project").groupBy("ty").agg(F.count("*").alias("n"))
    return counts.select("ty", F.round(0.7 * (1.0 / 3) + 0.3 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("prob"))


@query("""SELECT l_orderkey AS sample, l_linenumber AS node, l_returnflag AS gold, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END AS pred FROM lineitem WHERE l_returnflag <> CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END""")
def assignment_diff(t: Tables) -> DataFrame:
    pred = F.when(F.col("l_linestatus") == "F", "A").otherwise("N")
    return t.lineitem.where(F.col("l_returnflag") != pred).select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("node"), F.col("l_returnflag").alias("gold"), pred.alias("pred"))


@query("""WITH RECURSIVE nd AS (SELECT l_orderkey AS project, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity)::INT AS i, l_returnflag AS own, (1 + l_quantity) / (3 + l_quantity) AS p, 1 / (3 + l_quantity) AS q FROM lineitem),
bm AS (SELECT DISTINCT project, 0 AS i, '' AS path, 0.0::DOUBLE AS cost FROM nd UNION ALL SELECT project, i, path, cost FROM (
SELECT b.project, n.i, b.path || t.ty AS path, round(b.cost - ln(CASE WHEN n.own = t.ty THEN n.p ELSE n.q END) + CASE WHEN b.path = '' OR b.path[-1] = t.ty THEN 0 ELSE 0.5 END, 9) AS cost,
row_number() OVER (PARTITION BY b.project ORDER BY round(b.cost - ln(CASE WHEN n.own = t.ty THEN n.p ELSE n.q END) + CASE WHEN b.path = '' OR b.path[-1] = t.ty THEN 0 ELSE 0.5 END, 9), b.path || t.ty) AS r
FROM bm b JOIN nd n ON n.project = b.project AND n.i = b.i + 1 CROSS JOIN (VALUES ('A'), ('N'), ('R')) t(ty)) WHERE r <= 2),
last AS (SELECT project, max(i) AS top FROM nd GROUP BY 1)
SELECT bm.project, row_number() OVER (PARTITION BY bm.project ORDER BY cost, path)::INT AS rank, path, round(cost, 6) AS cost FROM bm JOIN last ON bm.project = last.project AND i = top""")
def beam_topk(t: Tables) -> DataFrame:
    """A beam of width 2 over all lines of an order; neighbours of different types cost half a unit."""
    node = F.struct("l_linenumber", "l_partkey", F.col("l_returnflag").alias("own"), ((1 + F.col("l_quantity")) / (3 + F.col("l_quantity"))).alias("p"), (1 / (3 + F.col("l_quantity"))).alias("q"))
    chains = t.lineitem.groupBy(F.col("l_orderkey").alias("project")).agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    beams = chains.select("project", F.posexplode(search.chain_beam(F.col("nodes"), ["A", "N", "R"], 2, 0.5)).alias("at", "b"))
    return beams.select("project", (F.col("at") + 1).alias("rank"), "b.path", F.round("b.cost", 6).alias("cost"))


def _bad_pairs(t: Tables) -> DataFrame:
    """Neighbouring lines of an order whose flags differ."""
    rows = t.lineitem.select(F.col("l_orderkey").cast("string").alias("project"), F.col("l_linenumber").cast("bigint").alias("a"), "l_returnflag")
    w = Window.partitionBy("project").orderBy("a")
    return rows.withColumn("b", F.lead("a").over(w)).withColumn("next", F.lead("l_returnflag").over(w)).where("next <> l_returnflag").select("project", "a", "b")


@query()
def patch_any(t: Tables) -> DataFrame:
    return search.patch_any(_bad_pairs(t))


def _search_input(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Per market segment and nation: customers as nodes, types by the quantities of their order lines, neighbours should agree."""
    project = F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string"))
    rows, others = (t.customer.select(project.alias("project"), F.col("c_custkey").alias("node")) for _ in range(2))
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("node"), F.col("l_returnflag").alias("type_id")).agg(F.sum("l_quantity").alias("q"))
    options = rows.select("*", F.explode(F.array(*[F.lit(x) for x in "ANR"])).alias("type_id"))
    weight = 1 + F.coalesce("q", F.lit(0.0))
    proposals = options.join(lines, ["node", "type_id"], "left").select("project", "node", "type_id", (weight / F.sum(weight).over(Window.partitionBy("node"))).alias("prob"))
    w = Window.partitionBy("project").orderBy("node")
    bonds = others.withColumn("b", F.lead("node").over(w)).where("b IS NOT NULL").select("project", F.col("node").alias("a"), "b")
    return proposals, bonds


@query()
def anneal_search(t: Tables) -> DataFrame:
    return search.anneal(*_search_input(t))


@query()
def ce_search(t: Tables) -> DataFrame:
    return search.cross_entropy_search(*_search_input(t))


@query()
def anneal_log(t: Tables) -> DataFrame:
    """Every epoch of a search with weighted neighbours, corrections and reboots."""
    return search.anneal_trace(*_search_input(t), neighbour="weighted", correction="weighted", reboot=True, epochs=100)


@query()
def ce_log(t: Tables) -> DataFrame:
    return search.cross_entropy_trace(*_search_input(t))


@query()
def beam_search(t: Tables) -> DataFrame:
    """Whole assignments of projects, by a beam under the constraints."""
    return search.beam_search(*_search_input(t), width=3)


@query()
def sampled_assignments(t: Tables) -> DataFrame:
    return search.sampled_assignments(*_search_input(t), samples=3)


@query("""WITH RECURSIVE c AS (SELECT c_nationkey AS p, c_custkey AS node, 1 + floor(abs(c_acctbal)) AS cost, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS next FROM customer),
r AS (SELECT p, node, k, cost AS owing, 0.0::DOUBLE AS left_over, next FROM c WHERE k = 1
UNION ALL SELECT c.p, c.node, c.k, CASE WHEN owing > 1e-6 AND cost > 1e-6 THEN cost - least(owing, cost) ELSE cost END, CASE WHEN owing > 1e-6 AND cost > 1e-6 THEN owing - least(owing, cost) ELSE owing END, c.next FROM r JOIN c ON c.p = r.p AND c.k = r.k + 1),
f AS (SELECT p, node, k, coalesce(lead(left_over) OVER (PARTITION BY p ORDER BY k), owing)::DOUBLE AS left_over FROM r)
SELECT p::INT AS project, node, left_over, left_over = 0 AS covered FROM f WHERE p IN (SELECT p FROM c WHERE k = 2)""")
def weighted_cover(t: Tables) -> DataFrame:
    """The pricing method over each nation's customers, of whom neighbours in the order of keys are bad pairs: what is left of each one's cost."""
    w = Window.partitionBy("project").orderBy("a")
    rows = t.customer.select(F.col("c_nationkey").cast("int").alias("project"), F.col("c_custkey").cast("bigint").alias("a"), (1 + F.floor(F.abs("c_acctbal"))).cast("double").alias("cost_a"))
    pairs = rows.select("*", F.lead("a").over(w).alias("b"), F.lead("cost_a").over(w).alias("cost_b")).where("b IS NOT NULL")
    return search.weighted_cover(pairs)


@query("""WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT pos::INT AS pos, count(*) AS batch_size FROM s, LATERAL (SELECT unnest(range(n)) AS pos) GROUP BY 1""")
def sequence_batches(t: Tables) -> DataFrame:
    return dataset.position_batches(t.conversations.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "n")


@query("""WITH x AS (SELECT conv_id, turn, length(text)::DOUBLE AS x FROM conversations), s AS (SELECT conv_id, avg(x) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS f, avg(x) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS b, turn FROM x)
SELECT conv_id, turn, round((f + b) / 2, 8) AS state FROM s""")
def bidirectional_mean(t: Tables) -> DataFrame:
    """Forward and backward running means of a sequence, averaged."""
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("double").alias("x"))
    run = lambda order: F.avg("x").over(Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("conv_id", "turn", F.round((run(F.col("turn")) + run(F.desc("turn"))) / 2, 8).alias("state"))


@query("""WITH m AS (SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id) AS last FROM events), r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id = last THEN 0 ELSE 1 END, md5('1|' || user_id || '|' || event_id), event_id) AS k FROM m) SELECT user_id, event_id FROM r WHERE k <= 20""")
def select_points(t: Tables) -> DataFrame:
    """At most twenty points of each series for a plot, the last one among them."""
    return dataset.select_points(t.events.select("user_id", "event_id"), "user_id", "event_id", 20)


@query("""WITH i AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS idx FROM (SELECT DISTINCT p_type FROM part)) SELECT p_type, idx FROM i ORDER BY md5('1|' || idx), idx LIMIT 10""")
def indexed_sample(t: Tables) -> DataFrame:
    """A uniform sample of ten from an indexed set."""
    return dataset.uniform_sample(dataset.indexed_set(t.part, "p_type"), "p_type", 10)


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, n, coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c""")
def stack_positions(t: Tables) -> DataFrame:
    """Where the rows of each conversation begin when all are stacked."""
    return dataset.stack_positions(t.conversations.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "n")
