"""Vector, loss, attention and optimizer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators.graph import small
from ..operators.messages import attention, residual
from ..operators.order import adam_moves, in_ranges
from ..operators.ranking import best, top_n
from ..sources.tables import Tables
from .registry import query

#: Elements of a vector in the tables; only the SQL needs it.
DIM = 64
EMB = """emb AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"""
LOGITS = f"""{EMB}, logits AS (SELECT vec_id, label, i::INT AS candidate, v[i + 1] AS logit FROM emb, range({DIM}) r(i))"""


def whole(t: Tables) -> DataFrame:
    """vec_id, label, v: all elements as doubles."""
    return t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def elements(rows: DataFrame, vector: str, *keys: str, digits: int = 5) -> DataFrame:
    """keys, i, x: a row for each element, rounded."""
    return rows.select(*keys, F.posexplode(vector).alias("i", "x")).select(*keys, "i", F.round("x", digits).alias("x"))


def logits(t: Tables) -> DataFrame:
    return whole(t).select("vec_id", "label", F.posexplode("v").alias("candidate", "logit"))


@query(f"WITH {EMB} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS self_dot, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM emb")
def l2_norm(t: Tables) -> DataFrame:
    return whole(t).select("vec_id", F.round(V.dot(F.col("v"), F.col("v")), 6).alias("self_dot"), F.round(V.norm(F.col("v")), 6).alias("norm"))


CENTROIDS = f"""{EMB}, parts AS (SELECT label, i, avg(v[i + 1]) AS x FROM emb, range({DIM}) r(i) GROUP BY 1, 2), cent AS (SELECT label AS cls, list(x ORDER BY i) AS c FROM parts GROUP BY 1)"""


def centroids(t: Tables) -> DataFrame:
    return V.sum_vectors(whole(t), ["label"], "v", "c", mean=True).withColumnRenamed("label", "cls")


@query(f"""WITH {CENTROIDS} SELECT vec_id, cls, round(list_sum(list_transform(range(1, {DIM} + 1), lambda i: v[i] * c[i])), 5) AS dot,
round(list_sum(list_transform(range(1, {DIM} + 1), lambda i: v[i] * c[i])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(c, lambda x: x * x)))), 5) AS cosine FROM emb, cent""")
def similarity_decode(t: Tables) -> DataFrame:
    """Every vector against the centroid of every class; there is one centroid per label."""
    rows = whole(t).join(small(centroids(t)))
    return rows.select("vec_id", "cls", F.round(V.dot(F.col("v"), F.col("c")), 5).alias("dot"), F.round(V.cosine(F.col("v"), F.col("c")), 5).alias("cosine"))


@query(f"WITH {LOGITS}, s AS (SELECT vec_id, candidate, exp(logit - max(logit) OVER w) AS e, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, candidate)::INT AS rank FROM logits WINDOW w AS (PARTITION BY vec_id)), p AS (SELECT *, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS prob FROM s) SELECT vec_id, candidate, rank, prob FROM p WHERE rank <= 3")
def topn_softmax(t: Tables) -> DataFrame:
    return top_n(logits(t), ["vec_id"], "logit", "candidate", 3).select("vec_id", "candidate", "rank", F.round("prob", 6).alias("prob"))


@query(f"WITH {LOGITS} SELECT vec_id, candidate FROM (SELECT vec_id, candidate, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, candidate) AS r FROM logits) WHERE r = 1")
def argmax_predictions(t: Tables) -> DataFrame:
    return best(logits(t), ["vec_id"], "logit", "candidate")


@query(f"WITH {LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, candidate)::INT AS rank FROM logits) SELECT vec_id, rank AS position FROM r WHERE candidate = label")
def truth_position(t: Tables) -> DataFrame:
    """Rank of the truth among all candidates."""
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("logit"), "candidate"))
    return logits(t).withColumn("position", rank).where(F.col("candidate") == F.col("label")).select("vec_id", "position")


@query(f"WITH {EMB}, s AS (SELECT vec_id, v[1] AS gate, v[2:len(v) // 2] AS lib, v[len(v) // 2 + 1:] AS proj FROM emb) SELECT vec_id, CASE WHEN gate > 0 THEN list_position(lib, list_max(lib)) - 1 ELSE list_position(proj, list_max(proj)) - 1 + len(lib) END::INT AS predicted FROM s")
def two_stage_predictions(t: Tables) -> DataFrame:
    """The first logit decides between library candidates, the rest of the first half, and project candidates, the second half."""
    v, half = F.col("v"), F.floor(F.size("v") / 2).cast("int")
    place = lambda part: (F.array_position(part, F.array_max(part)) - 1).cast("int")
    lib, proj = F.slice(v, F.lit(2), half - 1), F.slice(v, half + 1, F.size("v") - half)
    return whole(t).select("vec_id", F.when(F.element_at(v, 1) > 0, place(lib)).otherwise(place(proj) + half - 1).alias("predicted"))


@query(f"WITH {EMB} SELECT vec_id, round(ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) + list_max(v) - v[label + 1], 6) AS loss FROM emb")
def cross_entropy_softmax(t: Tables) -> DataFrame:
    return whole(t).select("vec_id", F.round(V.cross_entropy_softmax(F.col("v"), F.col("label")), 6).alias("loss"))


@query(f"WITH {EMB} SELECT vec_id, round(list_avg(list_transform(v, lambda z: ln(1 + exp(-z)) * (label % 2)::DOUBLE + (1 - (label % 2)::DOUBLE) * (z + ln(1 + exp(-z))))), 6) AS loss FROM emb")
def cross_entropy_sigmoid(t: Tables) -> DataFrame:
    """Mean over all elements, as logits of the same truth."""
    losses = F.transform("v", lambda z: V.cross_entropy_sigmoid(z, (F.col("label") % 2).cast("double")))
    return whole(t).select("vec_id", F.round(V.total(losses) / F.size("v"), 6).alias("loss"))


@query(f"WITH {EMB}, l AS (SELECT label, ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) + list_max(v) - v[label + 1] AS loss FROM emb) SELECT label, round(ln(avg(exp(loss))), 5) AS sum_loss, round(avg(loss), 5) AS product_loss FROM l GROUP BY 1")
def loss_sum_product(t: Tables) -> DataFrame:
    """Losses of a group by log-mean-exp and by mean."""
    loss = V.cross_entropy_softmax(F.col("v"), F.col("label"))
    return whole(t).select("label", loss.alias("loss")).groupBy("label").agg(F.round(F.log(F.avg(F.exp("loss"))), 5).alias("sum_loss"), F.round(F.avg("loss"), 5).alias("product_loss"))


@query(f"WITH {EMB} SELECT vec_id, list_transform(range(10), lambda k: CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0.0 END)::VARCHAR AS code FROM emb")
def one_hot(t: Tables) -> DataFrame:
    code = F.transform(V.one_hot(F.col("label"), 10), lambda x: F.when(x == 1, "1.0").otherwise("0.0"))
    return t.embeddings.select("vec_id", F.concat(F.lit("["), F.array_join(code, ", "), F.lit("]")).alias("code"))


@query(f"WITH {EMB}, n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM emb) SELECT vec_id, (i - 1)::INT AS i, round(CASE WHEN n > 0.3 THEN v[i] * 0.3 / n ELSE v[i] END, 5) AS x FROM n, range(1, {DIM} + 1) r(i)")
def clip_norm(t: Tables) -> DataFrame:
    return elements(whole(t).select("vec_id", V.clip_norm(F.col("v"), 0.3).alias("c")), "c", "vec_id")


@query(f"WITH {EMB}, e AS (SELECT vec_id, i::INT AS i, v[i + 1] AS x FROM emb, range({DIM}) r(i)) SELECT vec_id, i, round(greatest(x, 0), 6) AS relu, round(CASE WHEN x > 0 THEN x ELSE x * 0.2 END, 6) AS leaky, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(tanh(x), 6) AS tanh, round(ln(1 + exp(x)), 6) AS softplus, round(x * x, 6) AS square, round(x * x * x, 6) AS cubic FROM e")
def activations(t: Tables) -> DataFrame:
    x = F.col("x")
    rows = whole(t).select("vec_id", F.posexplode("v").alias("i", "x"))
    return rows.select("vec_id", "i", *[F.round(c, 6).alias(n) for n, c in (("relu", V.relu(x)), ("leaky", V.leaky_relu(x)), ("sigmoid", V.sigmoid(x)), ("tanh", F.tanh(x)), ("softplus", F.log(1 + F.exp(x))), ("square", x * x), ("cubic", x * x * x))])


def _labelled_messages(t: Tables) -> DataFrame:
    """Each vector sends itself to its label, which asks with the centroid."""
    return whole(t).select(F.col("label").alias("dst"), F.col("v").alias("value")).join(small(centroids(t).select(F.col("cls").alias("dst"), F.col("c").alias("query"))), "dst")


ATTENTION = f"""{CENTROIDS}, scored AS (SELECT label AS dst, v, list_sum(list_transform(range(1, {DIM} + 1), lambda i: v[i] * c[i])) AS d FROM emb JOIN cent ON label = cls),
leaky AS (SELECT dst, v, CASE WHEN d > 0 THEN d ELSE d * 0.2 END AS s FROM scored), e AS (SELECT dst, v, exp(s - max(s) OVER (PARTITION BY dst)) AS e FROM leaky),
a AS (SELECT dst, v, e / sum(e) OVER (PARTITION BY dst) AS alpha FROM e), att AS (SELECT dst, i, sum(v[i + 1] * alpha) AS x FROM a, range({DIM}) r(i) GROUP BY 1, 2)"""


@query(f"WITH {ATTENTION} SELECT dst, i::INT AS i, round(x, 5) AS x FROM att")
def segment_attention(t: Tables) -> DataFrame:
    return elements(attention(_labelled_messages(t)), "vec", "dst")


@query(f"WITH {CENTROIDS} SELECT cls, (i - 1)::INT AS i, round(c[i], 5) AS x FROM cent, range(1, {DIM} + 1) r(i)")
def mean_merge(t: Tables) -> DataFrame:
    return elements(centroids(t), "c", "cls")


@query(f"WITH {ATTENTION} SELECT vec_id, i::INT AS i, round(v[i + 1] + x * 0.5, 5) AS x FROM emb JOIN att ON label = dst")
def residual_step(t: Tables) -> DataFrame:
    """Embeddings plus half of what their label has gathered."""
    merged = attention(_labelled_messages(t)).select(F.col("dst").alias("label"), F.col("vec").alias("message"))
    rows = whole(t).join(small(merged), "label", "left")
    return elements(rows.select("vec_id", residual(F.col("v"), F.col("message"), 0.5).alias("vec")), "vec", "vec_id")


@query("""WITH RECURSIVE g AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT event_type, 0::BIGINT AS i, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v, 0.0::DOUBLE AS x FROM g WHERE i = 1 UNION ALL
SELECT s.event_type, g.i, s.m * 0.9 + g.value * (1 - 0.9::DOUBLE), s.v * 0.999 + g.value * g.value * (1 - 0.999::DOUBLE),
s.x - 0.001 * ((s.m * 0.9 + g.value * (1 - 0.9::DOUBLE)) / (1 - pow(0.9::DOUBLE, g.i))) / (sqrt((s.v * 0.999 + g.value * g.value * (1 - 0.999::DOUBLE)) / (1 - pow(0.999::DOUBLE, g.i))) + 1e-8) FROM s JOIN g ON g.event_type = s.event_type AND g.i = s.i + 1)
SELECT event_type, round(arg_max(x, i), 6) AS moved FROM s GROUP BY 1""")
def adam_step(t: Tables) -> DataFrame:
    """Change of a parameter by Adam steps over all events of each type, in order, their values being the gradients."""
    pieces = in_ranges(t.events.select("event_type", "ts", "event_id", "value"), "event_type", "ts", "event_id")
    return adam_moves(pieces, "event_type", "value", "string", 0.001).select("event_type", F.round("moved", 6).alias("moved"))


@query("""SELECT event_type, round(-0.01 * sum(value), 3) AS moved, round(sqrt(sum(value * value) / count(*)), 5) AS grad_norm FROM events GROUP BY 1""")
def sgd_step(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(-0.01 * F.sum("value"), 3).alias("moved"), F.round(F.sqrt(F.sum(F.col("value") * F.col("value")) / F.count("*")), 5).alias("grad_norm"))


@query("""SELECT k::INT AS k, round(2.0 * ln(2) / ln(k + 1), 6) AS log_t, round(2.0 * pow(0.95, k - 1), 6) AS exp_t, round(2.0::DOUBLE / k, 6) AS fast_t, round(greatest(0.3, 1 - 0.7 * k / 100), 6)::DOUBLE AS lr FROM (SELECT event_id + 1 AS k FROM events)""")
def anneal_schedules(t: Tables) -> DataFrame:
    """Temperatures and learning rates at the step of every event."""
    k = F.col("k")
    rows = t.events.select((F.col("event_id") + 1).cast("int").alias("k"))
    return rows.select("k", *[F.round(c, 6).alias(n) for n, c in (("log_t", S.anneal_log(2.0, k)), ("exp_t", S.anneal_exp(2.0, 0.95, k)), ("fast_t", S.anneal_fast(2.0, k)), ("lr", S.learning_rate_scale(k, 100).cast("double")))])


@query("""SELECT p_partkey, ((p_size - 25) % 7 + 7)::INT % 7 AS wrapped, least(greatest(p_size::DOUBLE, 10), 40) AS clamped, round(1 + p_size / 50.0::DOUBLE * 9, 6) AS linear, round(pow(10, p_size / 50.0::DOUBLE), 6) AS expo, round(pow(2, -pow(p_size / 20.0::DOUBLE, 4)), 6) AS gauss FROM part""")
def interpolations(t: Tables) -> DataFrame:
    a = F.col("p_size") / 50.0
    return t.part.select("p_partkey", S.wrap_in_range(F.col("p_size") - 25, 7).alias("wrapped"), S.clamp(F.col("p_size").cast("double"), 10.0, 40.0).alias("clamped"), F.round(S.linear_interpolate(a, 1.0, 10.0), 6).alias("linear"), F.round(S.exp_interpolate(a, 1.0, 10.0), 6).alias("expo"), F.round(S.gaussian_fourth_order(F.col("p_size"), 20.0), 6).alias("gauss"))


@query("""SELECT p_partkey, CASE WHEN p_partkey = 0 THEN '0' ELSE trim(array_to_string(string_split(p_partkey::VARCHAR, ''), ' ')) END AS digits FROM part""")
def nat_to_list(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(S.digits(F.col("p_partkey"), 10).cast("array<string>"), " ").alias("digits"))


@query("""WITH n AS (SELECT event_id, (value * 1e9)::BIGINT AS n FROM events) SELECT event_id, CASE WHEN n > 3600e9 THEN format('{:.3f}h', n / 3600e9) WHEN n > 1e9 THEN format('{:.3f}s', n / 1e9) WHEN n > 1e6 THEN format('{:.3f}ms', n / 1e6) WHEN n > 1e3 THEN format('{:.3f}µs', n / 1e3) ELSE format('{:.3f}ns', n::DOUBLE) END AS text FROM n""")
def format_time(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.pretty_time(F.round(F.col("value") * 1e9).cast("bigint")).alias("text"))


@query("""SELECT conv_id, turn, format('({},{})-({},{})', 1, 1, len(string_split(text, chr(10))), length(string_split(text, chr(10))[-1]) + 1) AS span FROM conversations""")
def span_text(t: Tables) -> DataFrame:
    """The span of a whole text, from one, as (line,column)-(line,column)."""
    lines = F.split("text", "\n", -1)
    return t.conversations.select("conv_id", "turn", F.format_string("(%d,%d)-(%d,%d)", F.lit(1), F.lit(1), F.size(lines), F.length(F.element_at(lines, -1)) + 1).alias("span"))


@query("""SELECT p_partkey, abs(p_size - 25) AS distance, abs(p_size / 50.0::DOUBLE - 0.5) <= 1e-8 AS half, round(pow(p_size / 50.0::DOUBLE, pow(50.0::DOUBLE, 2 * (0.5 - 0.7))), 6) AS curve, round(pow(p_size / 50.0::DOUBLE, pow(50.0::DOUBLE, 2 * (0.5 - 0.3))) * 9 + 1, 6) AS moved, '"' || p_name || '"' AS quoted FROM part""")
def scalar_extras(t: Tables) -> DataFrame:
    share = F.col("p_size") / 50.0
    return t.part.select("p_partkey", S.safe_abs(F.col("p_size") - 25).alias("distance"), S.nearly_equal(share, F.lit(0.5)).alias("half"), F.round(S.aggressive_sigmoid(share, 0.7), 6).alias("curve"), F.round(S.aggressive_interpolate(share, 0.3, 1.0, 10.0), 6).alias("moved"), S.in_quotes(F.col("p_name")).alias("quoted"))


@query("""WITH s AS (SELECT conv_id, turn, text, string_split(text, chr(10)) AS lines FROM conversations) SELECT conv_id, turn, CASE WHEN len(lines) = 1 THEN substr(lines[1], 3, 8) ELSE substr(lines[1], 3) || ' ...' END AS shown FROM s""")
def span_source(t: Tables) -> DataFrame:
    """The text of a span from the third letter: eight letters on one line, or the rest of the first of several lines."""
    lines = F.size(F.split("text", "\n", -1))
    return t.conversations.select("conv_id", "turn", S.source_text(F.col("text"), F.lit(0), F.lit(2), lines - 1, F.lit(10)).alias("shown"))


@query("""WITH g AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1), d AS (SELECT *, greatest(0, 1 - floor(log10(s))::INT) AS n FROM g)
SELECT event_type, CASE n WHEN 0 THEN format('{:.0f}', m) || '±' || format('{:.0f}', s) WHEN 1 THEN format('{:.1f}', m) || '±' || format('{:.1f}', s) WHEN 2 THEN format('{:.2f}', m) || '±' || format('{:.2f}', s) WHEN 3 THEN format('{:.3f}', m) || '±' || format('{:.3f}', s) ELSE 'more' END AS text FROM d""")
def mean_and_spread(t: Tables) -> DataFrame:
    stats = t.events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return stats.select("event_type", S.mean_and_spread(F.col("m"), F.col("s")).alias("text"))
