"""Names: segmentation, vocabularies, similarity, naming baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import segment_name, select_by_frequency
from ..operators.graph import checkpointed
from ..sources.tables import Tables, words
from .registry import query

#: segment_name in SQL, of the column `word`; the three cuts are done one after the other.
SEGMENTS = r"""
pieces AS (SELECT word, u.part AS part, u.i AS i FROM distinct_words, LATERAL (SELECT unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (SELECT regexp_split_to_array(word, '_+') AS p)) u WHERE NOT ends_with(word, 'Token')),
spaced AS (SELECT word, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(part, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([^A-Z])([A-Z])', '\1 \2', 'g'), '([^A-Z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([^A-Za-z])', '\1 \2', 'g'), '([A-Za-z])([^A-Za-z])', '\1 \2', 'g') AS s FROM pieces),
cleaned AS (SELECT word, i, list_filter(list_transform(regexp_split_to_array(s, '\s+'), lambda x: regexp_replace(lower(x), '[0-9]', '', 'g')), lambda x: x <> '') AS segs FROM spaced),
joined AS (SELECT word, i, CASE WHEN len(segs) >= 2 AND segs[1] = '$' THEN list_concat([concat('$', segs[2])], segs[3:]) ELSE segs END AS segs FROM cleaned),
segmented AS (SELECT word, flatten(list(segs ORDER BY i)) AS segs FROM joined GROUP BY word UNION ALL SELECT word, [word] FROM distinct_words WHERE ends_with(word, 'Token'))
"""


def _segment_counts(t: Tables) -> DataFrame:
    """Counts of segments over document texts: words are counted first, so each is segmented once."""
    counts = words(t.documents).groupBy("word").count()
    return counts.select(F.explode(segment_name(F.col("word"))).alias("segment"), "count").groupBy("segment").agg(F.sum("count").alias("uses"))


WORD_COUNTS = r"""
word_counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word),
distinct_words AS (SELECT word FROM word_counts),
"""


@query(
    "WITH " + WORD_COUNTS + SEGMENTS + r""",
uses AS (SELECT segment, sum(n)::BIGINT AS uses FROM (SELECT unnest(segs) AS segment, n FROM segmented JOIN word_counts USING (word)) GROUP BY segment HAVING sum(n) > 1),
shares AS (SELECT segment, uses, coalesce(sum(uses) OVER (ORDER BY uses DESC, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (sum(uses) OVER ())::DOUBLE AS covered FROM uses)
SELECT segment, uses FROM shares WHERE covered < 0.98
"""
)
def names_vocab(t: Tables) -> DataFrame:
    """Vocabulary of name segments that covers 98 % of their uses."""
    return select_by_frequency(_segment_counts(t), "segment", "uses", 0.98)


@query(
    r"""WITH word_counts AS (SELECT p_name AS word, count(*) AS n FROM part GROUP BY 1), distinct_words AS (SELECT word FROM word_counts), """ + SEGMENTS + r"""
SELECT p_partkey, array_to_string(segs, ' ') AS segments, len(segs)::INT AS n_segments FROM part JOIN segmented ON p_name = word"""
)
def name_segments(t: Tables) -> DataFrame:
    s = segment_name(F.col("p_name"))
    return t.part.select("p_partkey", F.array_join(s, " ").alias("segments"), F.size(s).alias("n_segments"))


@query(
    r"""WITH v AS (SELECT lower(w) AS label, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM benchmark) WHERE w <> '' GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (sum(n) OVER ())::DOUBLE AS covered FROM v)
SELECT label, n FROM s WHERE covered < 0.9"""
)
def label_vocab_090(t: Tables) -> DataFrame:
    counts = words(t.benchmark).groupBy(F.lower("word").alias("label")).agg(F.count("*").alias("n"))
    return select_by_frequency(counts, "label", "n", 0.9)


@query(
    r"""WITH w AS (SELECT lower(w) AS label, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM benchmark) WHERE w <> '' GROUP BY 1)
SELECT CASE WHEN n > 5 THEN -1 ELSE (('0x' || substr(md5(label), 1, 8))::BIGINT % 50)::INT END AS bucket, count(*) AS labels, sum(n)::BIGINT AS uses FROM w GROUP BY 1"""
)
def oov_bucket(t: Tables) -> DataFrame:
    """Labels outside the vocabulary get one of 50 buckets by hash; -1 is the vocabulary."""
    counts = words(t.benchmark).groupBy(F.lower("word").alias("label")).agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") > 5, -1).otherwise((F.conv(F.substring(F.md5("label"), 1, 8), 16, 10).cast("bigint") % 50).cast("int"))
    return counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("labels"), F.sum("n").alias("uses"))


SIMILAR = r"""part_segments AS (SELECT DISTINCT p_partkey, unnest(segs) AS segment FROM part JOIN segmented ON p_name = word)"""


@query(
    r"""WITH word_counts AS (SELECT p_name AS word, count(*) AS n FROM part GROUP BY 1), distinct_words AS (SELECT word FROM word_counts), """ + SEGMENTS + "," + SIMILAR + r""",
pairs AS (SELECT a.p_partkey AS part, b.p_partkey AS other, count(*) AS shared FROM part_segments a JOIN part_segments b ON a.segment = b.segment AND a.p_partkey <> b.p_partkey WHERE a.p_partkey % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY shared DESC, other)::INT AS rank FROM pairs)
SELECT part, other, shared, rank FROM r WHERE rank <= 5"""
)
def name_similarity_topk(t: Tables) -> DataFrame:
    """For every hundredth part the five whose names share most segments (a top-k report)."""
    parts = t.part.select("p_partkey", segment_name(F.col("p_name")).alias("segments"))
    return most_shared(parts, "p_partkey", "segments", F.col("id") % 100 == 0, 5).select(F.col("id").alias("part"), "other", "shared", "rank")


def most_shared(rows: DataFrame, key: str, segments: str, asked: Column, k: int) -> DataFrame:
    """id, other, shared, rank: for each row that is asked (a test of id) the k others that share most segments with it, smaller keys first.

    Rows of one set of segments share alike with all others, so sets meet sets, each with its k + 1 smallest keys: one may be
    the asking row itself.  Work follows the pairs of different sets, not of rows.
    """
    of_key = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(segments)))).alias("set"))
    rows = checkpointed(of_key.where(F.size("set") > 0))
    place = F.row_number().over(Window.partitionBy("set").orderBy("id"))
    least = checkpointed(rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("set").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    of_asked = rows.where(asked)
    sets = of_asked.select("set").distinct().select("set", F.explode("set").alias("segment"))
    others = least.select(F.col("set").alias("to"), F.explode("set").alias("segment"))
    shared = sets.join(others, "segment").groupBy("set", "to").agg(F.count("*").alias("shared"))
    met = shared.join(least.select(F.col("set").alias("to"), "ids"), "to").select("set", "shared", F.explode("ids").alias("other"))
    best = met.withColumn("place", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("shared"), "other"))).where(F.col("place") <= k + 1).select("set", "shared", "other")
    own = of_asked.join(best, "set").where("id <> other")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "other"))).where(F.col("rank") <= k).select("id", "other", "shared", "rank")


@query(
    r"""WITH c AS (SELECT split_part(p_name, ' ', 1) AS head, p_type, count(*) AS n FROM part GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY n DESC, p_type) AS rank FROM c)
SELECT p_brand, count(*) AS count, round(avg((rank = 1)::INT)::DOUBLE, 6) AS top1, round(avg((rank <= 5)::INT)::DOUBLE, 6) AS top5
FROM (SELECT p_brand, rank FROM part JOIN r ON split_part(p_name, ' ', 1) = head AND part.p_type = r.p_type) GROUP BY p_brand"""
)
def name_baseline_accuracy(t: Tables) -> DataFrame:
    """How often a part's type is the most, or among the five most, frequent of its name's first word."""
    head = F.element_at(F.split("p_name", " "), 1).alias("head")
    counts = t.part.groupBy(head, "p_type").count()
    ranks = counts.withColumn("rank", F.row_number().over(Window.partitionBy("head").orderBy(F.desc("count"), "p_type"))).drop("count")
    rows = t.part.select("p_brand", head, "p_type").join(ranks, ["head", "p_type"])
    return rows.groupBy("p_brand").agg(F.count("*").alias("count"), F.round(F.avg((F.col("rank") == 1).cast("int")), 6).alias("top1"), F.round(F.avg((F.col("rank") <= 5).cast("int")), 6).alias("top5"))


@query(
    r"""WITH c AS (SELECT p_type AS name, p_brand AS target, count(*) AS count FROM part GROUP BY 1, 2)
SELECT name, target, count FROM c"""
)
def naming_experiment(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("name"), F.col("p_brand").alias("target")).agg(F.count("*").alias("count"))
