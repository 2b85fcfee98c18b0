"""Ids, keyed merges, label statistics, ranges and two rounds of message passing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.graph import small
from ..operators.messages import residual
from ..operators.order import numbered
from ..sources.tables import Tables
from .registry import query
from .vectors import CENTROIDS, DIM, centroids, elements, whole


@query("""SELECT event_type AS series, min(ts) AS x_from, max(ts) AS x_to, min(value) AS y_from, max(value) AS y_to FROM events GROUP BY 1""")
def axis_ranges(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("series")).agg(F.min("ts").alias("x_from"), F.max("ts").alias("x_to"), F.min("value").alias("y_from"), F.max("value").alias("y_to"))


@query("""SELECT o_custkey AS project, count(*) FILTER (o_orderstatus = 'F') AS lib, count(*) FILTER (o_orderstatus <> 'F') AS proj,
round(CASE WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 1.0::DOUBLE ELSE (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE / (count(*) FILTER (o_orderstatus <> 'F'))::DOUBLE END, 6) AS ratio FROM orders GROUP BY 1""")
def label_stats(t: Tables) -> DataFrame:
    """Labels of either kind, and their ratio: 1 for a project without own labels."""
    lib, proj = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") != "F")
    rows = t.orders.groupBy(F.col("o_custkey").alias("project")).agg(lib.alias("lib"), proj.alias("proj"))
    return rows.withColumn("ratio", F.round(F.when(F.col("proj") == 0, 1.0).otherwise(F.try_divide("lib", "proj")), 6))


@query("""SELECT coalesce(d, l) AS k, CASE WHEN d IS NULL THEN 'left' ELSE 'right' END AS missing FROM (SELECT DISTINCT doc_id AS d FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS l FROM labels) ON d = l WHERE d IS NULL OR l IS NULL""")
def symmetric_key_check(t: Tables) -> DataFrame:
    """Keys that only one of two tables has: documents and the documents that labels name."""
    a = t.documents.select(F.col("doc_id").alias("a")).distinct()
    b = t.labels.select(F.col("doc_id").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full").where("a IS NULL OR b IS NULL").select(F.coalesce("a", "b").alias("k"), F.when(F.col("a").isNull(), "left").otherwise("right").alias("missing"))


@query("""WITH n AS (SELECT DISTINCT CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS name, CASE WHEN p_size > 40 THEN p_partkey END AS own FROM part), b AS (SELECT max(p_partkey) AS top FROM part) SELECT name, own, row_number() OVER (ORDER BY name NULLS LAST, own) + top AS id FROM n, b""")
def unknown_definitions(t: Tables) -> DataFrame:
    """One new id, above all old ones, for each unknown name, and one for each use without a name."""
    big = F.col("p_size") > 40
    unknown = t.part.select(F.when(~big, F.col("p_type")).alias("name"), F.when(big, F.col("p_partkey")).alias("own")).distinct()
    top = t.part.agg(F.max("p_partkey")).first()[0] or 0
    return numbered(unknown, [F.col("name").asc_nulls_last(), F.col("own")], "id", top + 1)


@query("""SELECT conv_id, map_keys(m)::VARCHAR AS roles, list_sum(map_values(m))::BIGINT AS total FROM (SELECT conv_id, map_from_entries(list((role, n) ORDER BY role)) AS m FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY 1)""")
def elementwise_combine(t: Tables) -> DataFrame:
    """Counters of each turn merged key by key."""
    counts = t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    rows = counts.groupBy("conv_id").agg(F.sort_array(F.collect_list("role")).alias("roles"), F.sum("n").alias("total"))
    return rows.select("conv_id", F.concat(F.lit("["), F.array_join("roles", ", "), F.lit("]")).alias("roles"), "total")


@query("""SELECT p_partkey, round(x * x * exp(-x * x / 100.0::DOUBLE) / sum(x * x * exp(-x * x / 100.0::DOUBLE)) OVER (PARTITION BY p_brand), 8) AS p FROM (SELECT p_partkey, p_brand, p_size::DOUBLE AS x FROM part)""")
def maxwell_distribution(t: Tables) -> DataFrame:
    x = F.col("p_size").cast("double")
    rows = t.part.select("p_partkey", "p_brand", (x * x * F.exp(-x * x / 100.0)).alias("d"))
    return rows.select("p_partkey", F.round(F.col("d") / F.sum("d").over(Window.partitionBy("p_brand")), 8).alias("p"))


@query(f"""WITH {CENTROIDS}, one AS (SELECT vec_id, label, list_transform(range(1, {DIM} + 1), lambda i: v[i] + 0.5 * c[i]) AS v FROM emb JOIN cent ON label = cls),
p2 AS (SELECT label, i, avg(v[i + 1]) AS x FROM one, range({DIM}) r(i) GROUP BY 1, 2), c2 AS (SELECT label AS cls, list(x ORDER BY i) AS c FROM p2 GROUP BY 1)
SELECT vec_id, (i - 1)::INT AS i, round(v[i] + 0.5 * c[i], 5) AS x FROM one JOIN c2 ON label = cls, range(1, {DIM} + 1) r(i)""")
def gnn_two_iterations(t: Tables) -> DataFrame:
    """Two rounds of gathering the mean of the neighbours and adding half of it."""
    rows = whole(t)
    for _ in range(2):
        merged = V.sum_vectors(rows, ["label"], "v", "c", mean=True)
        rows = rows.join(small(merged), "label").select("vec_id", "label", residual(F.col("v"), F.col("c"), 0.5).alias("v"))
    return elements(rows, "v", "vec_id")


@query(f"""WITH {CENTROIDS}, s AS (SELECT vec_id, label, cls, round(list_sum(list_transform(range(1, {DIM} + 1), lambda i: v[i] * c[i])), 6) AS d FROM emb, cent), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, cls) AS rank FROM s),
b AS (SELECT label AS cls, row_number() OVER (ORDER BY count(*) DESC, label) AS base FROM emb GROUP BY 1)
SELECT CASE WHEN rank < base THEN 'better' WHEN rank = base THEN 'same' ELSE 'worse' END AS outcome, count(*) AS n FROM r JOIN b USING (cls) WHERE label = r.cls GROUP BY 1""")
def naming_helpfulness(t: Tables) -> DataFrame:
    """Whether the model ranks the truth better than a baseline by frequency does."""
    scored = whole(t).join(small(centroids(t))).withColumn("d", F.round(V.dot(F.col("v"), F.col("c")), 6))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("d"), "cls"))
    truth = scored.withColumn("rank", rank).where(F.col("label") == F.col("cls"))
    base = whole(t).groupBy(F.col("label").alias("cls")).agg(F.count("*").alias("n")).withColumn("base", F.row_number().over(Window.orderBy(F.desc("n"), "cls"))).drop("n")
    outcome = F.when(F.col("rank") < F.col("base"), "better").when(F.col("rank") == F.col("base"), "same").otherwise("worse")
    return truth.join(small(base), "cls").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT a.conv_id, a.turn, b.page_id FROM conversations a JOIN (SELECT page_id, page_id % 50 AS c, page_id % 4 AS u FROM pages) b ON a.conv_id = b.c AND a.turn = b.u""")
def span_equality_join(t: Tables) -> DataFrame:
    """Predictions at exactly given places."""
    places = t.pages.select("page_id", (F.col("page_id") % 50).alias("conv_id"), (F.col("page_id") % 4).alias("turn"))
    return t.conversations.select("conv_id", "turn").join(places, ["conv_id", "turn"])


@query("""SELECT count(*) FILTER (toxic IS NULL) AS missing, count(*) FILTER (toxic = 1) AS annotated, count(*) FILTER (toxic = 0) AS inferred FROM documents LEFT JOIN labels USING (doc_id)""")
def annotation_counters(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rows.agg(F.count_if(F.col("toxic").isNull()).alias("missing"), F.count_if(F.col("toxic") == 1).alias("annotated"), F.count_if(F.col("toxic") == 0).alias("inferred"))
