"""The queries opN_<name>, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table

#: Rules of the url query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    held_out = remainder("doc_id", 4) == 2
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import cosine_links

    return cosine_links(table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import pareto_mix

    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + r["hi"] - r["lo"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), "kept_sha256")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    held_out = remainder("doc_id", 5) == 0
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE_KINDS, secret_spans, spans_text

    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_encode

    return bpe_encode(table(spark, sf_dir, "documents"), vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ((('0x' || substr(md5(doc_id::VARCHAR || ':17'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER w, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0)) AS level
      FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio >= level),
t AS (SELECT l.source, source_size, least(cap, coalesce(f.level, ratio) * weight) AS target FROM l CROSS JOIN f),
p AS (SELECT *, floor(coalesce(CASE WHEN source_size > 0 THEN target / source_size END, 0) + 1e-12) AS whole FROM t),
q AS (SELECT *, greatest(coalesce(CASE WHEN source_size > 0 THEN target / source_size END, 0) - whole, 0) AS p, greatest(target - whole * source_size, 0) AS lacks FROM p),
x AS (SELECT d.doc_id, d.size, q.*, CASE WHEN p > 0 AND p < 1 AND d.size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
y AS (SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE <= lacks AS near FROM x)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN size * (whole + CASE WHEN rank IS NOT NULL AND near THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken FROM y
"""

OP6_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (SELECT *, ('.' || host) LIKE '%.net' AS net, ('.' || host) LIKE '%.example.net' AS en, ('.' || host) LIKE '%.example.com' AS ec, ('.' || host) LIKE '%.org' AS org FROM u),
b AS (SELECT page_id, host, path,
        CASE WHEN en AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN ec AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN org AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN net AND starts_with(path, '/') THEN 'net/' END AS rule,
        regexp_replace(regexp_replace(path, '[0-9a-fA-F]{16,}', '{h}', 'g'), '[0-9]+', '{n}', 'g') AS shape FROM k),
v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM b),
x AS (SELECT host, path, shape, max(CASE WHEN ruled = 'block' THEN 1 ELSE 0 END) AS b, max(CASE WHEN ruled IS NOT NULL THEN 1 ELSE 0 END) AS m FROM v GROUP BY ALL),
g AS (SELECT host, shape, count(*) AS n, sum(b) AS b, sum(m) AS m FROM x GROUP BY ALL),
e AS (SELECT g.*, unnest(range(len(string_split(g.shape, '/')))) AS pos, string_split(shape, '/') AS parts FROM g),
o AS (SELECT host, shape, n, b, m, pos, parts[pos + 1] AS child, array_to_string(parts[1:pos], '/') AS prefix FROM e),
w AS (SELECT host, prefix, pos FROM (SELECT host, prefix, pos, child, sum(n) AS n FROM o GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 16 AND sum(n) < 2 * count(*)),
t AS (SELECT o.host, shape, n, b, m, list(CASE WHEN w.host IS NOT NULL THEN '*' ELSE child END ORDER BY o.pos) AS steps
      FROM o LEFT JOIN w ON o.host = w.host AND o.prefix = w.prefix AND o.pos = w.pos GROUP BY ALL),
l AS (SELECT host, shape, n, b, m, pos, steps[pos + 1] AS step, array_to_string(steps[1:pos], '/') AS prefix, coalesce(steps[pos + 2], '/') AS follows FROM (SELECT *, unnest(range(len(steps))) AS pos FROM t)),
cells AS (SELECT host, prefix, pos, step, follows, sum(n)::DOUBLE AS o, sum(b)::DOUBLE AS b, sum(m)::DOUBLE AS m FROM l GROUP BY ALL),
sums AS (SELECT *, sum(o) OVER s AS of_step, sum(b) OVER s AS b1, sum(m) OVER s AS m1, sum(o) OVER f AS of_next, sum(o) OVER a AS total, sum(b) OVER a AS b2, sum(m) OVER a AS m2
         FROM cells WINDOW s AS (PARTITION BY host, prefix, pos, step), f AS (PARTITION BY host, prefix, pos, follows), a AS (PARTITION BY host, prefix, pos)),
gs AS (SELECT host, prefix, pos, step, any_value(b1) AS b1, any_value(m1) AS m1, any_value(b2) AS b2, any_value(m2) AS m2,
         sum(2 * o * ln(o * total / (of_step * of_next)) + CASE WHEN of_next > o THEN 2 * (of_next - o) * ln((of_next - o) * total / ((total - of_step) * of_next)) ELSE 0 END)
         + any_value(2 * total * ln(total / (total - of_step))) - sum(2 * of_next * ln(total / (total - of_step))) AS g
       FROM sums WHERE total > of_step GROUP BY host, prefix, pos, step),
dfs AS (SELECT host, prefix, pos, count(DISTINCT follows) - 1 AS df FROM cells GROUP BY ALL),
gl AS (SELECT gs.*, df, CASE WHEN m1 > 0 AND m2 > m1 THEN
         (CASE WHEN b1 > 0 THEN 2 * b1 * ln(b1 * m2 / (m1 * b2)) ELSE 0 END) + (CASE WHEN m1 > b1 THEN 2 * (m1 - b1) * ln((m1 - b1) * m2 / (m1 * (m2 - b2))) ELSE 0 END)
         + (CASE WHEN b2 > b1 THEN 2 * (b2 - b1) * ln((b2 - b1) * m2 / ((m2 - m1) * b2)) ELSE 0 END) + (CASE WHEN m2 - m1 > b2 - b1 THEN 2 * (m2 - m1 - b2 + b1) * ln((m2 - m1 - b2 + b1) * m2 / ((m2 - m1) * (m2 - b2))) ELSE 0 END)
         ELSE 0 END AS g2 FROM gs JOIN dfs USING (host, prefix, pos)),
ok AS (SELECT host, prefix, pos, step FROM gl WHERE g <= df + 2 * sqrt(2 * df) + 1e-9 AND g2 <= 3.841),
z AS (SELECT l.host, shape, b, m, list(CASE WHEN ok.host IS NOT NULL THEN '+' ELSE l.step END ORDER BY l.pos) AS steps
      FROM l LEFT JOIN ok ON l.host = ok.host AND l.prefix = ok.prefix AND l.pos = ok.pos AND l.step = ok.step GROUP BY ALL),
nd AS (SELECT host, shape, b, m, depth, array_to_string(steps[1:depth], '/') AS node, CASE WHEN depth > 1 THEN array_to_string(steps[1:depth - 1], '/') ELSE '' END AS above FROM (SELECT *, unnest(range(len(steps) + 1)) AS depth FROM z)),
ct AS (SELECT host, depth, node, above, sum(b)::DOUBLE AS b, sum(m)::DOUBLE AS m FROM nd GROUP BY ALL),
pu AS (SELECT host, depth, node, (b + 2.0 * 0.5) / (m + 2.0) AS purity FROM ct WHERE depth = 0
       UNION ALL SELECT ct.host, ct.depth, ct.node, (ct.b + 2.0 * pu.purity) / (ct.m + 2.0) FROM ct JOIN pu ON ct.host = pu.host AND ct.depth = pu.depth + 1 AND (ct.depth = 1 OR ct.above = pu.node)),
j AS (SELECT z.host, shape, array_to_string(steps, '/') AS template, purity FROM z JOIN pu ON z.host = pu.host AND len(steps) = pu.depth AND array_to_string(steps, '/') = pu.node)
SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM v JOIN j ON v.host = j.host AND v.shape = j.shape
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
qt AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(terms) AS term FROM q) GROUP BY ALL),
dt AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM d),
w AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM dt CROSS JOIN s GROUP BY term),
m AS (SELECT k, doc_id, 100 - 75 + ((75 * len(terms) * s.n) // s.l) AS m FROM d CROSS JOIN s WHERE s.l > 0),
x AS (SELECT i, m.k, m.doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m.m)))::BIGINT AS score FROM qt JOIN dt USING (term) JOIN w USING (term) JOIN m ON dt.k = m.k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r JOIN q USING (i) WHERE rank <= 10
"""

OP13_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(concat(doc_id::VARCHAR, ':', run))), '..'), lambda b: ('0x' || b)::BIGINT)),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs CROSS JOIN crc),
e AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
lacks AS (SELECT word, n, pos, substring(word, 1, pos) || substring(word, pos + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS pos FROM w)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM lacks a JOIN lacks b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
  UNION SELECT w.word, w.n, b.word, b.n FROM w JOIN lacks b ON w.word = b.rest
  UNION SELECT b.word, b.n, w.word, w.n FROM w JOIN lacks b ON w.word = b.rest),
best AS (SELECT word, count(*) AS n_near, min(CASE WHEN near_n >= 5 * n THEN {'minus': -near_n, 'form': near} END) AS b FROM pairs GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, b.form AS form, (-b.minus)::BIGINT AS form_n FROM w LEFT JOIN best USING (word)),
t AS (SELECT word, word AS root FROM f UNION SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL),
last AS (SELECT t.word, t.root FROM t JOIN f ON t.root = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_embedding_dedup, op3_mix_sources, op4_repeated_passages, op5_near_dedup, op6_url_filters, op7_fingerprints, op8_toxicity, op9_secret_scan, op10_bpe, op11_lexical_search, op12_token_counts, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": OP3_SQL, "op6_url_filters": OP6_SQL, "op11_lexical_search": OP11_SQL, "op13_spelling_variants": OP13_SQL}
