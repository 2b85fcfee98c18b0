"""Vectors of types, labels and library nodes, message layers in blocks, attention over all names, a sparse step of training."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import select_by_frequency, segment_name
from ..functions.vectors import seeded_vector
from ..operators import blocks, encoders, gradients, lattice, lowering
from ..operators.blocks import Layer
from ..operators.graph import Stored, checkpointed, release
from ..operators.layers import seeded_weights
from ..operators.types import ast_sizes, nongenerify, subtype_pairs
from ..sources.tables import Tables, binary_relations
from .graphs import RELS
from .names import SEGMENTS
from .registry import query
from .syntax import LINE_TYPES, line_types
from .vectors import DIM, EMB, whole

#: Elements of the vectors here.
SIZE = 4


def layer(path: str, inputs: int, activation: str = "relu", bias: float | None = 0.05, outputs: int = SIZE) -> Layer:
    return Layer(seeded_weights(path, outputs, inputs), None if bias is None else [bias] * outputs, activation)


def sql_vector(key: str, size: int = SIZE) -> str:
    """seeded_vector in SQL."""
    return f"list_transform(range({size}), lambda i: ('0x' || substr(md5('1|' || {key} || '|' || i), 1, 12))::BIGINT / {1 << 47}::DOUBLE - 1)"


def sql_layer(made: Layer, *parts: str) -> str:
    """A layer of vectors of SIZE elements in SQL."""
    terms = lambda row: " + ".join(f"({p})[{i + 1}] * ({row[k * SIZE + i]})::DOUBLE" for k, p in enumerate(parts) for i in range(SIZE))
    line = [f"{(made.bias or [0.0] * made.size)[j]}::DOUBLE + {terms(row)}" for j, row in enumerate(made.weights)]
    return "[" + ", ".join(f"greatest({x}, 0)" if made.activation == "relu" else x for x in line) + "]"


def sql_sum(vector: str, size: int = SIZE, how: str = "sum") -> str:
    return "[" + ", ".join(f"{how}({vector}[{i + 1}])" for i in range(size)) + "]"


def sql_rounded(vector: str, digits: int = 5) -> str:
    """A column for each element."""
    return ", ".join(f"round(({vector})[{i + 1}], {digits}) + 0 AS v{i}" for i in range(SIZE))


def rounded(vector: str, digits: int = 5) -> list[Column]:
    return [(F.round(F.get(vector, F.lit(i)), digits) + 0.0).alias(f"v{i}") for i in range(SIZE)]


# types

FUNCTION, RECORD, TERM = layer("encodeFunction", 2 * SIZE), layer("encodeObject", 2 * SIZE), layer("encodeLibTerm", 3 * SIZE)
EMPTY = seeded_weights("emptyObject", 1, SIZE)[0]


def type_graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(types, children): a nation is an object with its region, a customer one with nation and segment, an order a function from a customer to the type of its lines."""
    made = lambda df, tag, key, kind: df.select(F.concat(F.lit(tag), F.col(key).cast("string")).alias("type_id"), F.lit(kind).alias("kind"), (F.concat(F.lit(tag), F.col(key).cast("string")) if kind == "var" else F.lit(None).cast("string")).alias("name"))
    held = lambda df, tag, key, pos, label, child: df.select(F.concat(F.lit(tag), F.col(key).cast("string")).alias("type_id"), F.lit(pos).alias("pos"), F.lit(label).cast("string").alias("label"), child.alias("child"))
    of = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
    lines = checkpointed(line_types(t))
    types, children = lattice.hash_consed(lines, "type")
    types = types.union(made(t.region, "r:", "r_regionkey", "var")).union(made(t.customer.select("c_mktsegment").distinct(), "m:", "c_mktsegment", "var"))
    types = types.union(made(t.nation, "n:", "n_nationkey", "object")).union(made(t.customer, "c:", "c_custkey", "object")).union(made(lines, "o:", "l_orderkey", "func"))
    orders = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    parts = [
        held(t.nation, "n:", "n_nationkey", 0, "region", of("r:", "n_regionkey")), held(t.customer, "c:", "c_custkey", 0, "nation", of("n:", "c_nationkey")),
        held(t.customer, "c:", "c_custkey", 1, "segment", of("m:", "c_mktsegment")), held(orders, "o:", "o_orderkey", 0, None, of("c:", "o_custkey")), held(orders, "o:", "o_orderkey", -1, None, F.col("type")),
    ]
    return checkpointed(types), checkpointed(reduce(DataFrame.union, parts, children))


TYPE_TEXTS = f"""{LINE_TYPES}, ft AS (SELECT DISTINCT type, label, ty FROM w JOIN m USING (l_orderkey)), cx AS (SELECT 'c:' || c_custkey AS id, '{{nation: {{region: r:' || n_regionkey || '}}, segment: m:' || c_mktsegment || '}}' AS text FROM customer JOIN nation ON c_nationkey = n_nationkey),
tx AS (SELECT 'r:' || r_regionkey AS id, 'var' AS kind, 1 AS size, 'r:' || r_regionkey AS text FROM region UNION ALL SELECT DISTINCT 'm:' || c_mktsegment, 'var', 1, 'm:' || c_mktsegment FROM customer
UNION ALL SELECT DISTINCT ty, CASE WHEN ty = 'any' THEN 'any' ELSE 'var' END, 1, ty FROM w UNION ALL SELECT 'n:' || n_nationkey, 'object', 2, '{{region: r:' || n_regionkey || '}}' FROM nation UNION ALL SELECT id, 'object', 4, text FROM cx
UNION ALL SELECT DISTINCT type, 'object', 1 + n, type FROM m UNION ALL SELECT 'o:' || o_orderkey, 'func', 6 + n, '(' || text || ')->' || type FROM orders JOIN m ON l_orderkey = o_orderkey JOIN cx ON id = 'c:' || o_custkey)"""


@query(f"WITH {TYPE_TEXTS} SELECT id AS type_id, text FROM tx")
def type_pretty(t: Tables) -> DataFrame:
    """Every type of the graph of types as text."""
    return lowering.type_texts(*type_graph(t))


@query(f"WITH {TYPE_TEXTS} SELECT id AS type_id, size::BIGINT AS size FROM tx")
def type_ast_size(t: Tables) -> DataFrame:
    """Tree sizes of the same types."""
    return ast_sizes(*type_graph(t))


@query(f"WITH {TYPE_TEXTS} SELECT id AS type_id, CASE kind WHEN 'func' THEN 'Function' WHEN 'var' THEN text ELSE 'any' END AS target FROM tx")
def nongenerify_types(t: Tables) -> DataFrame:
    return nongenerify(type_graph(t)[0])


@query(f"""WITH {TYPE_TEXTS}, ts AS (SELECT DISTINCT type AS x, false AS leaf FROM m UNION ALL SELECT DISTINCT ty, true FROM w),
bad AS (SELECT DISTINCT a.x AS c, p.type AS p FROM ts a JOIN ft p ON true LEFT JOIN ft k ON k.type = a.x AND k.label = p.label AND (k.ty = p.ty OR k.ty = 'any' OR p.ty = 'any') WHERE NOT a.leaf AND k.type IS NULL)
SELECT a.x AS child, b.x AS parent FROM ts a, ts b WHERE a.x = b.x OR a.x = 'any' OR b.x = 'any' OR (NOT a.leaf AND NOT b.leaf AND NOT EXISTS (SELECT 1 FROM bad WHERE c = a.x AND p = b.x))""")
def subtype_pairs_fixpoint(t: Tables) -> DataFrame:
    """All pairs of subtypes among the types of lines and their parts."""
    types, children = lattice.hash_consed(checkpointed(line_types(t)), "type")
    return subtype_pairs(checkpointed(types), checkpointed(children))


def type_embeddings(t: Tables) -> DataFrame:
    types, children = type_graph(t)
    leaves = types.where("kind IN ('any', 'var')").select("type_id", seeded_vector(F.concat(F.lit("leaf/"), F.col("type_id")), SIZE).alias("vec"))
    labels = children.where("label IS NOT NULL").select("label").distinct().select("label", seeded_vector(F.concat(F.lit("label/"), F.col("label")), SIZE).alias("vec"))
    return encoders.encode_types(types, children, leaves, labels, FUNCTION, RECORD, EMPTY)


def sql_position(pos: int) -> str:
    return "[" + ", ".join(f"{'sin' if i % 2 == 0 else 'cos'}({pos} / pow(10000.0::DOUBLE, {i - i % 2} / {SIZE}.0::DOUBLE))" for i in range(SIZE)) + "]"


def sql_record(child: str, label: str) -> str:
    return sql_layer(RECORD, sql_vector(label), child)


TYPE_VECTORS = f"""{LINE_TYPES},
leaf AS (SELECT 'r:' || r_regionkey AS id FROM region UNION SELECT 'm:' || c_mktsegment FROM customer UNION SELECT ty FROM w),
v0 AS MATERIALIZED (SELECT id, {sql_vector("'leaf/' || id")} AS v FROM leaf),
nv AS MATERIALIZED (SELECT 'n:' || n_nationkey AS id, {sql_record('v', "'label/region'")} AS v FROM nation JOIN v0 ON id = 'r:' || n_regionkey),
lt AS (SELECT DISTINCT type, label, ty FROM w JOIN m USING (l_orderkey)),
lp AS MATERIALIZED (SELECT label, ty, {sql_record('v', "'label/' || label")} AS p FROM (SELECT DISTINCT label, ty FROM lt) JOIN v0 ON id = ty),
lv AS MATERIALIZED (SELECT type AS id, {sql_sum('p')} AS v FROM lt JOIN lp USING (label, ty) GROUP BY type),
cp AS (SELECT c_custkey, {sql_record('nv.v', "'label/nation'")} AS a, {sql_record('v0.v', "'label/segment'")} AS b FROM customer JOIN nv ON nv.id = 'n:' || c_nationkey JOIN v0 ON v0.id = 'm:' || c_mktsegment),
cv AS MATERIALIZED (SELECT 'c:' || c_custkey AS id, [{', '.join(f'a[{i + 1}] + b[{i + 1}]' for i in range(SIZE))}] AS v FROM cp),
op AS (SELECT o_orderkey, {sql_layer(FUNCTION, 'cv.v', sql_position(0))} AS a, {sql_layer(FUNCTION, 'lv.v', sql_position(-1))} AS b FROM orders JOIN m ON l_orderkey = o_orderkey JOIN cv ON cv.id = 'c:' || o_custkey JOIN lv ON lv.id = type),
tv AS (SELECT * FROM v0 UNION ALL SELECT * FROM nv UNION ALL SELECT * FROM lv UNION ALL SELECT * FROM cv UNION ALL SELECT 'o:' || o_orderkey, [{', '.join(f'a[{i + 1}] + b[{i + 1}]' for i in range(SIZE))}] FROM op)"""


@query(f"WITH {TYPE_VECTORS} SELECT id AS type_id, {sql_rounded('v')} FROM tv")
def type_vectors(t: Tables) -> DataFrame:
    """A vector for every type of the graph of types, from the leaves up."""
    return type_embeddings(t).select("type_id", *rounded("vec"))


NAME = layer("encodeSeg", SIZE)


def sql_segment(segment: str, known: str) -> str:
    return sql_vector(f"CASE WHEN {known} THEN 'segments/' || {segment} ELSE 'segments/?' || (('0x' || substr(md5({segment}), 1, 8))::BIGINT % {encoders.BUCKETS}) END")


def label_sql(source: str, uses: str) -> str:
    """CTEs up to labels(word, vec), for the words that `source` selects and a vocabulary of segments by `uses` of each word."""
    return rf"""word_counts AS ({source}), distinct_words AS (SELECT word FROM word_counts), {SEGMENTS},
flat AS (SELECT word, unnest(segs) AS segment FROM segmented), used AS (SELECT segment, sum(n)::BIGINT AS uses FROM flat JOIN word_counts USING (word) GROUP BY segment HAVING sum(n) > 1),
shares AS (SELECT segment, coalesce(sum(uses) OVER (ORDER BY uses DESC, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (sum(uses) OVER ())::DOUBLE AS covered FROM used),
raw AS MATERIALIZED (SELECT f.segment, {sql_segment('f.segment', 's.segment IS NOT NULL')} AS r FROM (SELECT DISTINCT segment FROM flat) f LEFT JOIN (SELECT segment FROM shares WHERE covered < {uses}) s ON s.segment = f.segment),
unit AS (SELECT segment, list_transform(r, lambda x: x / sqrt({' + '.join(f'r[{i + 1}] * r[{i + 1}]' for i in range(SIZE))})) AS u FROM raw),
made AS MATERIALIZED (SELECT segment, {sql_layer(NAME, 'u')} AS p FROM unit),
labels AS (SELECT d.word, {'[' + ', '.join(f'coalesce(sum(p[{i + 1}]), 0)' for i in range(SIZE)) + ']'} AS vec FROM distinct_words d LEFT JOIN flat USING (word) LEFT JOIN made USING (segment) GROUP BY d.word)"""


def named(counts: DataFrame, coverage: float) -> DataFrame:
    """label, vec of counts(word, n): segments are weighed by the uses of their words, those outside the coverage share buckets."""
    counts = checkpointed(counts)
    uses = counts.select("n", F.explode(segment_name(F.col("word"))).alias("segment")).groupBy("segment").agg(F.sum("n").alias("uses"))
    vocabulary = checkpointed(select_by_frequency(uses, "segment", "uses", coverage))
    return encoders.encode_labels(counts, "word", vocabulary, NAME, SIZE)


PART_LABELS = label_sql("SELECT p_name AS word, count(*) AS n FROM part GROUP BY 1", "0.9")


@query(f"WITH {PART_LABELS} SELECT p_partkey, {sql_rounded('vec')} FROM part JOIN labels ON p_name = word")
def label_vectors(t: Tables) -> DataFrame:
    """A vector for the name of every part; each name is encoded once."""
    made = named(t.part.groupBy(F.col("p_name").alias("word")).agg(F.count("*").alias("n")), 0.9)
    return t.part.join(made, F.col("p_name") == F.col("label")).select("p_partkey", *rounded("vec"))


@query(f"""WITH {label_sql("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ ]+')) AS word FROM conversations) WHERE word <> '' GROUP BY 1", "0.9")} SELECT word, {sql_rounded('vec')} FROM labels""")
def word_vectors(t: Tables) -> DataFrame:
    """A vector for every word of the conversations, by their segments."""
    counts = t.conversations.select(F.explode(F.split("text", "[ ]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    return named(counts, 0.9).select(F.col("label").alias("word"), *rounded("vec"))


TERM_NAMES = label_sql("SELECT name AS word, count(*) AS n FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier) GROUP BY 1", "0.98")


@query(f"""WITH {TYPE_VECTORS}, {TERM_NAMES}, terms AS (SELECT 'c:' || c_custkey AS node, 'c:' || c_custkey AS sig, c_name AS name FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, s_name FROM supplier),
own AS (SELECT node, v, vec, {sql_vector("'libNode/' || node")} AS e FROM terms JOIN tv ON tv.id = sig JOIN labels ON word = name)
SELECT node, {sql_rounded(sql_layer(TERM, 'e', 'v', 'vec'))} FROM own UNION ALL SELECT id, {sql_rounded('v')} FROM tv WHERE id LIKE 'n:%' OR id LIKE 'r:%'""")
def library_vectors(t: Tables) -> DataFrame:
    """Library nodes: types (nations, regions) by their signatures, terms (customers, suppliers) by a vector of their own, the signature and the name."""
    vectors = checkpointed(type_embeddings(t))
    names = named(t.customer.select(F.col("c_name").alias("word")).union(t.supplier.select("s_name")).groupBy("word").agg(F.count("*").alias("n")), 0.98)
    terms = t.customer.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("node"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("type_id"), F.col("c_name").alias("label"))
    terms = terms.union(t.supplier.select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")), "s_name"))
    made = encoders.encode_terms(terms, vectors, names, TERM, SIZE)
    own = vectors.where(F.startswith("type_id", F.lit("n:")) | F.startswith("type_id", F.lit("r:"))).select(F.col("type_id").alias("node"), "vec")
    return made.union(own).select("node", *rounded("vec"))


# messages

KINDS = {f"{k}/{way}": layer(f"{k}/{way}", 2 * SIZE) for k in ("inheritance", "subtype", "equal", "assign") for way in ("up", "down")}
MESSAGES = f"""{RELS}, m AS (SELECT lhs AS dst, rhs AS src, category || '/up' AS kind FROM rels UNION ALL SELECT rhs, lhs, category || '/down' FROM rels),
ids AS (SELECT dst AS id FROM m UNION SELECT src FROM m), vs AS MATERIALIZED (SELECT id, {sql_vector("'node/' || id")} AS v FROM ids)"""


def typed_messages(t: Tables) -> DataFrame:
    """dst, kind, own, other: messages in both directions, with the vectors of both nodes."""
    rels = binary_relations(t)
    both = rels.select(F.col("lhs").alias("dst"), F.col("rhs").alias("src"), F.concat("category", F.lit("/up")).alias("kind")).union(rels.select("rhs", "lhs", F.concat("category", F.lit("/down"))))
    vector = lambda c: seeded_vector(F.concat(F.lit("node/"), F.col(c)), SIZE)
    return both.select("dst", "kind", vector("dst").alias("own"), vector("src").alias("other"))


@query(f"""WITH {MESSAGES}, y AS (SELECT dst, CASE kind {' '.join(f"WHEN '{k}' THEN {sql_layer(x, 'a.v', 'b.v')}" for k, x in KINDS.items())} END AS y FROM m JOIN vs a ON a.id = dst JOIN vs b ON b.id = src)
SELECT dst AS node, count(*) AS n, {sql_rounded(sql_sum('y', how='avg'))} FROM y GROUP BY dst""")
def message_layers(t: Tables) -> DataFrame:
    """Messages of each kind through a layer of the kind, over both nodes' vectors, and their mean for each node."""
    made = blocks.summed_layers(typed_messages(t), "dst", "kind", ["own", "other"], KINDS, "vec", mean=True)
    return made.select(F.col("dst").alias("node"), "n", *rounded("vec"))


HEADS = [tuple(layer(f"head{h}/{x}", SIZE, "none", None, SIZE // 2) for x in ("keys1", "keys2", "values2")) for h in range(2)]


def _head_sql(h: int) -> str:
    own, other, value = HEADS[h]
    return f"""s{h} AS (SELECT dst, list_dot_product({sql_layer(own, 'a.v')}, {sql_layer(other, 'b.v')}) AS z, {sql_layer(value, 'b.v')} AS x FROM m JOIN vs a ON a.id = dst JOIN vs b ON b.id = src),
e{h} AS (SELECT dst, x, exp(z - max(z) OVER (PARTITION BY dst)) AS e FROM (SELECT dst, x, CASE WHEN z > 0 THEN z ELSE 0.2 * z END AS z FROM s{h})),
h{h} AS (SELECT dst, [{', '.join(f'sum(e * x[{i + 1}]) / sum(e)' for i in range(SIZE // 2))}] AS v FROM e{h} GROUP BY dst)"""


@query(f"WITH {MESSAGES}, {_head_sql(0)}, {_head_sql(1)} SELECT h0.dst AS node, {sql_rounded('list_concat(h0.v, h1.v)')} FROM h0 JOIN h1 USING (dst)")
def message_attention(t: Tables) -> DataFrame:
    """Messages weighted by two heads of attention, in mergeable parts for each batch of rows."""
    made = blocks.attended_messages(typed_messages(t), "dst", "own", "other", HEADS, "vec")
    return made.select(F.col("dst").alias("node"), *rounded("vec"))


# attention over all names

ASK, KEYS, VALUES = layer("ask", DIM, "none", None), layer("space/keys", SIZE, "none", None), layer("space/values", SIZE, "none", None)
DEFAULT = (seeded_weights("space/defaultK", 1, SIZE)[0], seeded_weights("space/defaultV", 1, SIZE)[0])
ASKED = "[" + ", ".join(" + ".join(f"v[{i + 1}] * ({w})::DOUBLE" for i, w in enumerate(row)) for row in ASK.weights) + "]"


def asking(t: Tables) -> DataFrame:
    return blocks.apply_layers(whole(t).withColumn("kind", F.lit("ask")), "kind", ["v"], {"ask": ASK}, "q").select("vec_id", "q")


def names_with_counts(t: Tables) -> DataFrame:
    """label, n, vec: every name of parts, and how many have it."""
    counts = checkpointed(t.part.groupBy(F.col("p_name").alias("word")).agg(F.count("*").alias("n")))
    return counts.join(named(counts, 0.9), F.col("word") == F.col("label")).select("label", "n", "vec")


def name_candidates(t: Tables) -> DataFrame:
    """p_partkey, p_name, vec: the names of all parts as a prediction space."""
    made = named(t.part.groupBy(F.col("p_name").alias("word")).agg(F.count("*").alias("n")), 0.9)
    return t.part.join(made, F.col("p_name") == F.col("label")).select("p_partkey", "p_name", "vec")


def added(met: DataFrame, queries: DataFrame) -> DataFrame:
    """vec_id, v0, ..: the queries' vectors plus what they attend to."""
    both = queries.join(met.withColumnRenamed("vec_id", "_id"), F.col("vec_id") == F.col("_id"))
    return both.select("vec_id", F.zip_with("q", "seen", lambda a, b: a + b).alias("vec")).select("vec_id", *rounded("vec"))


SPACE = f"""{EMB}, q AS MATERIALIZED (SELECT vec_id, {ASKED} AS q FROM emb), {PART_LABELS},
kv AS MATERIALIZED (SELECT {sql_layer(KEYS, 'vec')} AS k, {sql_layer(VALUES, 'vec')} AS x FROM part JOIN labels ON p_name = word UNION ALL SELECT {DEFAULT[0]}::DOUBLE[], {DEFAULT[1]}::DOUBLE[])"""


@query(f"""WITH {SPACE}, z AS (SELECT vec_id, q, x, list_dot_product(q, k) AS z FROM q, kv), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z)
SELECT vec_id, {', '.join(f'round(any_value(q[{i + 1}]) + sum(e * x[{i + 1}]) / sum(e), 5) + 0 AS v{i}' for i in range(SIZE))} FROM e GROUP BY vec_id""")
def attend_names(t: Tables) -> DataFrame:
    """Every vector attends to the names of all parts: blocks of vectors meet blocks of names."""
    queries = checkpointed(asking(t))
    space = names_with_counts(t).withColumn("kind", F.lit("space"))  # parts of one name are equal, so a name counts as often as it has parts
    keyed = blocks.apply_layers(blocks.apply_layers(space, "kind", ["vec"], {"space": KEYS}, "k"), "kind", ["vec"], {"space": VALUES}, "x")
    return added(blocks.attended_set(queries, "vec_id", "q", keyed, "k", "x", "seen", DEFAULT, times="n"), queries)


@query(f"""WITH {PART_LABELS}, sets AS (SELECT word, list_sort(list_distinct(segs)) AS segs, vec FROM segmented JOIN labels USING (word)),
z AS (SELECT a.p_partkey, len(list_intersect(x.segs, y.segs)) AS z, y.vec FROM part a JOIN sets x ON a.p_name = x.word, part b JOIN sets y ON b.p_name = y.word WHERE a.p_partkey % 100 = 0 UNION ALL SELECT p_partkey, 1, {DEFAULT[1]}::DOUBLE[] FROM part WHERE p_partkey % 100 = 0),
own AS (SELECT p_partkey, vec FROM part JOIN labels ON p_name = word)
SELECT p_partkey, {', '.join(f'round(any_value(own.vec[{i + 1}]) + sum(exp(z) * z.vec[{i + 1}]) / sum(exp(z)), 5) + 0 AS v{i}' for i in range(SIZE))} FROM z JOIN own USING (p_partkey) GROUP BY p_partkey""")
def attend_by_name(t: Tables) -> DataFrame:
    """Every hundredth part (a query set) attends to all parts by the segments that their names share."""
    space = checkpointed(name_candidates(t))
    asked = space.where("p_partkey % 100 = 0")
    seen = encoders.attend_by_name(asked, "p_partkey", "p_name", space, "p_name", "vec", SIZE, DEFAULT[1]).withColumnRenamed("p_partkey", "_id")
    return asked.join(seen, F.col("p_partkey") == F.col("_id")).select("p_partkey", F.zip_with("vec", "seen", lambda a, b: a + b).alias("vec")).select("p_partkey", *rounded("vec"))


# a sparse step of training

RATE, MOST = 4.0, 1.0
BAG = f"""d AS (SELECT doc_id, word, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL),
ws AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS r FROM (SELECT DISTINCT word FROM d)), tab AS MATERIALIZED (SELECT word, r, {sql_vector("'words/' || word")} AS v FROM ws),
wt AS (SELECT {seeded_weights('out', 1, SIZE)[0]}::DOUBLE[] AS w),
x AS (SELECT doc_id, [{', '.join(f'sum(v[{i + 1}] * tf) / sum(tf)' for i in range(SIZE))}] AS x, sum(tf) AS n FROM d JOIN tab USING (word) GROUP BY doc_id),
y AS (SELECT doc_id, (lang = 'en')::INT::DOUBLE AS y FROM documents), p AS (SELECT doc_id, x, n, y, 1 / (1 + exp(-list_dot_product(x, w))) AS p FROM x JOIN y USING (doc_id), wt),
e AS (SELECT *, (p - y) / (count(*) OVER ()) AS e FROM p), gs AS (SELECT word, sum(e * tf / n) AS s FROM d JOIN e USING (doc_id) GROUP BY word),
g AS (SELECT 'words' AS param, word, list_transform(w, lambda c: c * s) AS g FROM gs, wt UNION ALL SELECT 'out', NULL, {sql_sum('list_transform(x, lambda c: c * e)')} FROM e),
nm AS (SELECT param, sqrt(sum(list_dot_product(g, g))) AS norm FROM g GROUP BY param),
c AS (SELECT param, word, list_transform(g, lambda c: c * CASE WHEN norm > {MOST} THEN {MOST}::DOUBLE / norm ELSE 1 END) AS g FROM g JOIN nm USING (param))"""


@query(f"""WITH {BAG} SELECT 'words' AS param, word, (i - 1)::INT AS col, round(tab.v[i] - {RATE}::DOUBLE * c.g[i], 6) + 0 AS value FROM tab JOIN c USING (word), range(1, {SIZE + 1}) r(i)
UNION ALL SELECT 'out', NULL, (i - 1)::INT, round(w[i] - {RATE}::DOUBLE * g[i], 6) + 0 FROM wt, c, range(1, {SIZE + 1}) r(i) WHERE param = 'out'""")
def embedding_step(t: Tables) -> DataFrame:
    """A step of training a table of word vectors, and weights over their mean, to tell English documents: only words that occur have a gradient."""
    tokens = t.documents.select("doc_id", F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''").groupBy("doc_id", "word").agg(F.count("*").cast("double").alias("tf"))
    kept = Stored(t.spark, "embedding-step")
    tokens = kept.put("tokens", tokens)
    ids = kept.put("ids", tokens.select("word").distinct().withColumn("row", F.xxhash64("word")))  # a row number that needs no order
    release(t.spark)
    entries = tokens.withColumn("row", F.xxhash64("word")).select("doc_id", "row", "tf")
    table = gradients.cells(ids.withColumn("v", seeded_vector(F.concat(F.lit("words/"), F.col("word")), SIZE)), "words", "row", "v")
    out = t.spark.createDataFrame([("out", 0, i, w) for i, w in enumerate(seeded_weights("out", 1, SIZE)[0])], gradients.SCHEMA)
    parameters = kept.put("parameters", table.unionByName(out))
    truth = t.documents.select("doc_id", (F.col("lang") == "en").cast("double").alias("y"))
    found, _ = gradients.logistic_bag_gradient(entries, "doc_id", "row", "tf", truth, parameters, "words", "out")
    release(t.spark)
    moved = gradients.sgd(parameters, gradients.clip_norm(kept.put("found", found), MOST), RATE)
    named_rows = moved.join(ids.select(F.col("row").alias("_r"), "word"), (F.col("param") == "words") & (F.col("row") == F.col("_r")), "left")
    return named_rows.select("param", "word", "col", (F.round("value", 6) + 0.0).alias("value"))
