"""Accuracies, confusion, statistics and ordered summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import accuracy
from ..operators.metrics import confusion, counted, mutual_information, r_squared, upper_median
from ..operators.order import affine_fold, in_ranges
from ..sources.tables import Tables
from .registry import query


@query(
    """SELECT source, count(*) AS count, coalesce(sum((quality = toxic)::INT), 0)::BIGINT AS correct, sum((quality = toxic)::INT)::DOUBLE / count(*)::DOUBLE AS accuracy
FROM documents JOIN labels USING (doc_id) GROUP BY source"""
)
def counted_accuracy(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id")
    return counted(rows, ["source"], F.col("quality") == F.col("toxic"))


@query("""SELECT q.quality AS truth, x.toxic AS prediction, count(l.doc_id) AS n FROM (SELECT DISTINCT quality FROM labels) q CROSS JOIN (SELECT DISTINCT toxic FROM labels) x
LEFT JOIN labels l ON l.quality = q.quality AND l.toxic = x.toxic GROUP BY 1, 2""")
def confusion_matrix(t: Tables) -> DataFrame:
    return confusion(t.labels, "quality", "toxic")


@query("""SELECT l_shipmode, n, late, late::DOUBLE / n::DOUBLE AS accuracy FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n, sum((l_linestatus = 'F')::INT)::BIGINT AS late FROM lineitem GROUP BY 1)""")
def per_class_accuracy(t: Tables) -> DataFrame:
    out = counted(t.lineitem.select(F.col("l_returnflag").alias("l_shipmode"), "l_linestatus"), ["l_shipmode"], F.col("l_linestatus") == "F")
    return out.select("l_shipmode", F.col("count").alias("n"), F.col("correct").alias("late"), "accuracy")


@query("""SELECT CASE WHEN grouping(is_lib) = 1 THEN 'total' WHEN is_lib THEN 'lib' ELSE 'proj' END AS part, count(*) AS count, sum(ok)::BIGINT AS correct, sum(ok)::DOUBLE / count(*)::DOUBLE AS accuracy
FROM (SELECT o_orderstatus = 'F' AS is_lib, (o_orderpriority LIKE '1%')::INT AS ok FROM orders) GROUP BY GROUPING SETS ((is_lib), ())""")
def accuracy_grouping_sets(t: Tables) -> DataFrame:
    """Library, project and total accuracy in one pass."""
    rows = t.orders.select((F.col("o_orderstatus") == "F").alias("is_lib"), F.col("o_orderpriority").startswith("1").cast("int").alias("ok"))
    g = rows.groupingSets([[F.col("is_lib")], []], F.col("is_lib")).agg(F.grouping("is_lib").alias("g"), F.count("*").alias("count"), F.sum("ok").alias("correct"))
    part = F.when(F.col("g") == 1, "total").when(F.col("is_lib"), "lib").otherwise("proj")
    return g.select(part.alias("part"), "count", "correct", accuracy(F.col("correct"), F.col("count")).alias("accuracy"))


@query("""WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, l_returnflag FROM lineitem)
SELECT l_returnflag, round(sum(l_quantity), 4) AS weight, round(sum(CASE WHEN rank <= 3 THEN l_quantity ELSE 0 END), 4) AS correct FROM r GROUP BY 1""")
def weighted_topn_accuracy(t: Tables) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    rows = t.lineitem.select("l_returnflag", "l_quantity", rank.alias("rank"))
    return rows.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 4).alias("weight"), F.round(F.sum(F.when(F.col("rank") <= 3, F.col("l_quantity")).otherwise(0.0)), 4).alias("correct"))


@query("""WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_totalprice AS median FROM r WHERE i = n // 2 + 1""")
def upper_median_by_customer(t: Tables) -> DataFrame:
    return upper_median(t.orders, ["o_custkey"], "o_totalprice")


@query("""SELECT user_id, count(*) AS n, round(coalesce(var_samp(value), 0), 4) AS variance, round(coalesce(stddev_samp(value), 0), 4) AS stdev FROM events GROUP BY user_id""")
def var_samp_guard(t: Tables) -> DataFrame:
    """Sample variance, 0 for a single value."""
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.coalesce(F.var_samp("value"), F.lit(0.0)), 4).alias("variance"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("stdev"))


@query("""SELECT event_type, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 4) AS std FROM events GROUP BY event_type""")
def var_pop_numeric(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.var_pop("value"), 4).alias("variance"), F.round(F.stddev_pop("value"), 4).alias("std"))


@query("""WITH j AS (SELECT p_brand, p_type, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2), f AS (SELECT n / sum(n) OVER () AS pxy, sum(n) OVER (PARTITION BY p_brand) / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY p_type) / sum(n) OVER () AS py FROM j)
SELECT round(sum(pxy * log2(pxy / (px * py))), 6) AS mi FROM f""")
def mutual_information_bits(t: Tables) -> DataFrame:
    return mutual_information(t.part, "p_brand", "p_type").select(F.round("mi", 6).alias("mi"))


@query("""WITH d AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p, l_discount AS w FROM lineitem), m AS (SELECT sum(y * w) / count(*) AS mean FROM d)
SELECT round(1 - sum((y - p) * (y - p) * w) / sum((y - mean) * (y - mean) * w), 6) AS r2 FROM d, m""")
def r_squared_weighted(t: Tables) -> DataFrame:
    return r_squared(t.lineitem, F.col("l_extendedprice"), F.col("l_quantity") * 1000, F.col("l_discount")).select(F.round("r2", 6).alias("r2"))


@query("""SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY 1""")
def weighted_average(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity"), 4).alias("mean"))


def _events(t: Tables):
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("""SELECT event_id, user_id, max(value) OVER w AS running_max, min(value) OVER w AS running_min FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_extremes(t: Tables) -> DataFrame:
    w = _events(t).rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", "user_id", F.max("value").over(w).alias("running_max"), F.min("value").over(w).alias("running_min"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, value AS mean FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, f.mean * (1 - 1.0::DOUBLE / least(e.i, 10)) + e.value * (1.0::DOUBLE / least(e.i, 10)) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, round(arg_max(mean, i), 4) AS mean FROM f GROUP BY user_id""")
def running_average(t: Tables) -> DataFrame:
    """Mean over the first 10 values, then an exponential one, in order: a fold for each user, range by range of the order."""
    def steps(before: int, values):
        share = 1 / np.minimum(np.arange(before + 1, before + 1 + len(values)), 10)
        return 1 - share, values * share

    pieces = in_ranges(t.events.select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id")
    return affine_fold(pieces, "user_id", "value", steps, "bigint").select("user_id", F.round("state", 4).alias("mean"))


@query("""WITH d AS (SELECT ts::DATE AS day, round(max(value), 6) AS y FROM events GROUP BY 1), b AS (SELECT day, y, row_number() OVER (ORDER BY day) AS epoch, max(y) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
i AS (SELECT epoch, y, coalesce(y > before, true) AS improved, max(CASE WHEN coalesce(y > before, true) THEN epoch END) OVER (ORDER BY epoch) AS last_best FROM b)
SELECT min(epoch)::INT AS stop_epoch FROM i WHERE epoch - last_best >= 3""")
def early_stop_epoch(t: Tables) -> DataFrame:
    """First day on which the daily best has not improved for three days (days are few)."""
    w = Window.orderBy("day")
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.max("value"), 6).alias("y"))
    days = days.withColumn("epoch", F.row_number().over(w)).withColumn("before", F.max("y").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    days = days.withColumn("last_best", F.max(F.when(F.coalesce(F.col("y") > F.col("before"), F.lit(True)), F.col("epoch"))).over(w))
    return days.where("epoch - last_best >= 3").agg(F.min("epoch").alias("stop_epoch"))


@query("""SELECT user_id, round(value / sum(value) OVER (PARTITION BY user_id), 6) AS p, event_id FROM events""")
def normalize_distribution(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.round(F.col("value") / F.sum("value").over(Window.partitionBy("user_id")), 6).alias("p"), "event_id")


@query("""SELECT event_type AS name, day_of_month AS iteration, round(avg(value), 9) AS value FROM (SELECT event_type, day(ts)::INT AS day_of_month, value FROM events) GROUP BY 1, 2""")
def event_log_rows(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("name"), F.dayofmonth("ts").alias("iteration")).agg(F.round(F.avg("value"), 9).alias("value"))


@query("""SELECT event_type, (props->>'k')::INT % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_props(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 10
    return t.events.groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM conversations) WHERE word <> '' GROUP BY word""".replace("\\\\", "\\"))
def occurrence_map(t: Tables) -> DataFrame:
    from ..sources.tables import words

    return words(t.conversations).groupBy("word").agg(F.count("*").alias("n"))


@query("""SELECT gold, pred, count(*) AS count, round(avg(gp), 9) AS gold_prob, round(avg(pp), 9) AS pred_prob, sum((pp IS NULL)::INT)::BIGINT AS unseen
FROM (SELECT o_orderpriority AS gold, l_returnflag AS pred, l_discount AS gp, CASE WHEN l_tax > 0.02 THEN l_tax END AS pp FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus <> o_orderstatus) GROUP BY 1, 2""")
def diff_stats(t: Tables) -> DataFrame:
    """Differences between two assignments by what they assign."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_linestatus <> o_orderstatus")
    pp = F.when(F.col("l_tax") > 0.02, F.col("l_tax"))
    return rows.groupBy(F.col("o_orderpriority").alias("gold"), F.col("l_returnflag").alias("pred")).agg(
        F.count("*").alias("count"), F.round(F.avg("l_discount"), 9).alias("gold_prob"), F.round(F.avg(pp), 9).alias("pred_prob"), F.count_if(pp.isNull()).alias("unseen")
    )
