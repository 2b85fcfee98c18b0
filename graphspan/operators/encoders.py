"""Vectors of types, labels and library nodes.

A type's vector comes from those of its parts: each (position, type) of a function
and each (label, type) of an object goes through a layer, and the results are summed.
Types are hash-consed, so a type that many others hold is encoded once; levels of
nesting are encoded from the leaves up, and a level reads nothing but the sums that
lower levels have written for it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import segment_name
from ..functions.vectors import relu, seeded_vector, sum_arrays, unit
from .blocks import Layer
from .graph import checkpointed, small, topological_levels
from .layers import encode_position, linear

#: A segment with more uses than this is split when labels meet their segments.
HOT = 100_000
#: Parts of a hot segment.
SPLIT = 64
#: Names outside the vocabulary share so many vectors.
BUCKETS = 50


def scratch(df: DataFrame, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    checkpointed(df.sparkSession.range(1))  # sets the folder if need be
    return f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def halves(layer: Layer, left: int) -> tuple[list[list[float]], list[list[float]]]:
    """The weights for the first `left` inputs, and for the others: what a layer makes of two vectors is a sum of two products."""
    return [row[:left] for row in layer.weights], [row[left:] for row in layer.weights]


def plus_relu(a: Column, b: Column, bias: list[float] | None) -> Column:
    summed = F.zip_with(a, b, lambda x, y: x + y)
    if bias is not None:
        summed = F.zip_with(summed, F.array(*[F.lit(float(v)) for v in bias]), lambda x, y: x + y)
    return F.transform(summed, relu)


def encode_types(types: DataFrame, children: DataFrame, leaves: DataFrame, labels: DataFrame, function: Layer, record: Layer, empty: list[float]) -> DataFrame:
    """type_id, vec: of types of any depth that do not contain themselves.

    types(type_id, kind, name) and children(type_id, pos, label, child) as
    `hash_consed` gives them; leaves(type_id, vec) of kinds any and var;
    labels(label, vec).  function takes a part's vector and the encoding of its
    position (-1: the result), record a label's vector and a part's; `empty`
    is the vector of an object without fields.  Leaves without a vector, and types above
    them, have no row.

    A child's product with either layer is made once, when its vector is known;
    an occurrence costs an addition.  Sums are written by the level of the
    parent, so each is read once.  A child that very many types hold is left to
    skew joins: both sides of the join are plain shuffles.
    """
    size = len(empty)
    of_child, of_position = halves(function, size)
    of_label, of_field = halves(record, len(record.weights[0]) - size)
    levels = checkpointed(topological_levels(children.select(F.col("child").alias("src"), F.col("type_id").alias("dst"))).select(F.col("node").alias("t"), "level"))
    top = levels.agg(F.max("level")).first()[0] or 0
    held = children.join(types.select(F.col("type_id").alias("t"), "kind"), F.col("type_id") == F.col("t")).drop("t")
    held = held.join(levels, F.col("type_id") == F.col("t")).drop("t")
    known = labels.select(F.col("label").alias("l"), linear(F.col("vec"), of_label).alias("label_part"))
    held = held.join(small(checkpointed(known)), F.col("label") == F.col("l"), "left")
    place = linear(encode_position(F.col("pos").cast("double"), len(of_position[0])), of_position)
    edges = checkpointed(held.select("type_id", "level", "kind", F.col("child"), F.when(F.col("kind") == "func", place).otherwise(F.col("label_part")).alias("part")))
    folder = scratch(types, "type-sums")
    needed = checkpointed(children.groupBy(F.col("type_id").alias("t")).agg(F.count("*").alias("needed")))

    def pass_on(frontier: DataFrame, mode: str) -> None:
        """What vectors of one level add to the types that hold them."""
        child = frontier.select(F.col("type_id").alias("c"), linear(F.col("vec"), of_child).alias("as_argument"), linear(F.col("vec"), of_field).alias("as_field"))
        met = edges.join(checkpointed(child), F.col("child") == F.col("c"))
        message = F.when(F.col("kind") == "func", plus_relu(F.col("as_argument"), F.col("part"), function.bias)).otherwise(plus_relu(F.col("as_field"), F.col("part"), record.bias))
        sums = sum_arrays(met.select("type_id", "level", message.alias("m")), ["type_id", "level"], "m", size, "vec", "n")
        sums.write.mode(mode).partitionBy("level").parquet(folder)

    inner = types.join(needed, F.col("type_id") == F.col("t"), "left_anti")
    start = inner.where("kind IN ('any', 'var')").select("type_id").join(leaves.select(F.col("type_id").alias("t"), "vec"), F.col("type_id") == F.col("t")).select("type_id", "vec")
    bare = inner.where("kind = 'object'").select("type_id", F.array(*[F.lit(float(v)) for v in empty]).alias("vec"))
    done = frontier = checkpointed(start.union(bare))
    for level in range(1, top + 1):
        pass_on(frontier, "append")
        spark = types.sparkSession
        rows = spark.read.schema("type_id string, vec array<double>, n bigint, level int").parquet(folder).where(F.col("level") == level)
        sums = sum_arrays(rows, ["type_id"], "vec", size, "vec").join(rows.groupBy(F.col("type_id").alias("r")).agg(F.sum("n").alias("got")), F.col("type_id") == F.col("r"))
        frontier = checkpointed(sums.join(needed, F.col("type_id") == F.col("t")).where("got = needed").select("type_id", "vec"))
        done = done.union(frontier)
    path = types.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(types.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return done


def encode_terms(terms: DataFrame, signatures: DataFrame, names: DataFrame, layer: Layer, size: int, seed: int = 1) -> DataFrame:
    """node, vec of library terms(node, type_id, label): a layer over a vector of the node's own, its signature's and its name's.

    signatures(type_id, vec), names(label, vec).  Without a label the vector of the name is zero; terms whose
    signature has no vector have no row.
    """
    nothing = F.array(*[F.lit(0.0)] * size)
    met = terms.join(signatures.select(F.col("type_id").alias("_t"), F.col("vec").alias("_signature")), F.col("type_id") == F.col("_t"))
    met = met.join(names.select(F.col("label").alias("_l"), F.col("vec").alias("_name")), F.col("label") == F.col("_l"), "left")
    own = seeded_vector(F.concat(F.lit("libNode/"), F.col("node")), size, seed)
    joined = F.concat(own, F.col("_signature"), F.coalesce("_name", nothing))
    return met.select("node", F.transform(linear(joined, layer.weights, layer.bias), relu).alias("vec"))


def sparse_dense_sums(entries: DataFrame, key: str, column: str, times: str, dense: DataFrame, dense_key: str, vector: str, size: int, out: str, hot: int = HOT, split: int = SPLIT) -> DataFrame:
    """key, out: the sum of times * vector over entries(key, column, times), a sparse matrix by the dense rows dense(dense_key, vector).

    Columns with more than `hot` entries are met in `split` parts: their entries are
    dealt by a hash of their key, and their row is there once for each part.  Sums are
    combined before they are shuffled by key.  Entries whose column has no row add nothing.
    """
    entries = checkpointed(entries.select(key, column, times))
    crowded = checkpointed(entries.groupBy(F.col(column).alias("_c")).count().where(F.col("count") > hot).select("_c", F.lit(True).alias("_hot")))
    crowded = small(crowded)
    dealt = entries.join(crowded, F.col(column) == F.col("_c"), "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(key), F.lit(split))).otherwise(0)).drop("_c", "_hot")
    rows = dense.select(F.col(dense_key).alias("_d"), F.col(vector).alias("_v")).join(crowded, F.col("_d") == F.col("_c"), "left")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(split - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    rows = rows.select("_d", "_v", F.explode(parts).alias("_p"))
    met = dealt.join(rows, (F.col(column) == F.col("_d")) & (F.col("_part") == F.col("_p")))
    return sum_arrays(met.select(key, F.transform("_v", lambda x: x * F.col(times)).alias("_x")), [key], "_x", size, out)


def segment_vectors(segments: DataFrame, vocabulary: DataFrame, size: int, buckets: int = BUCKETS, seed: int = 1) -> DataFrame:
    """segment, vec: a unit vector of the segment's own if vocabulary(segment) has it, else that of one of the buckets, by a hash."""
    known = vocabulary.select(F.col("segment").alias("_v"), F.lit(True).alias("_known"))
    bucket = F.conv(F.substring(F.md5("segment"), 1, 8), 16, 10).cast("bigint") % buckets
    key = F.when(F.col("_known"), F.concat(F.lit("segments/"), F.col("segment"))).otherwise(F.concat(F.lit("segments/?"), bucket.cast("string")))
    return segments.join(known, F.col("segment") == F.col("_v"), "left").select("segment", unit(seeded_vector(key, size, seed)).alias("vec"))


def encode_labels(uses: DataFrame, label: str, vocabulary: DataFrame, layer: Layer, size: int, dropout: float = 0.0, common: DataFrame | None = None, run: int = 0, hot: int = HOT) -> DataFrame:
    """label, vec for each distinct label of uses: the sum of its segments' vectors after a layer, zero without segments.

    A segment goes through the layer once, however many labels have it, and a
    label is encoded once for a run.  With dropout, segments that are not in
    common(segment) take the vector of a bucket with that probability, by a hash of segment and run.
    """
    labels = checkpointed(uses.select(F.col(label).alias("label")).where("label IS NOT NULL").distinct())
    entries = labels.select("label", F.explode(segment_name(F.col("label"))).alias("segment")).groupBy("label", "segment").agg(F.count("*").cast("double").alias("times"))
    entries = checkpointed(entries)
    segments = entries.select("segment").distinct()
    kept = vocabulary.select("segment")
    if dropout > 0:
        draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(run)), "segment").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
        often = common.select("segment") if common is not None else kept.limit(0)
        kept = kept.where(draw >= dropout).union(kept.join(often, "segment", "left_semi")).distinct()
    vectors = segment_vectors(segments, kept, size)
    made = checkpointed(vectors.select("segment", F.transform(linear(F.col("vec"), layer.weights, layer.bias), relu).alias("part")))
    sums = sparse_dense_sums(entries, "label", "segment", "times", made, "segment", "part", layer.size, "vec", hot)
    zero = F.array(*[F.lit(0.0)] * layer.size)
    return labels.join(sums.withColumnRenamed("label", "_l"), F.col("label") == F.col("_l"), "left").select("label", F.coalesce("vec", zero).alias("vec"))


def attend_by_name(queries: DataFrame, id_col: str, name: str, candidates: DataFrame, candidate_name: str, vector: str, size: int, default: list[float], sharpness: float = 1.0, guardian: float = 1.0) -> DataFrame:
    """id, seen: all candidates' vectors weighted by the softmax of the segments that their names share with a query's, and a default of score `guardian`.

    Most names share nothing, and all of these weigh alike: the sum over all
    candidates is made once, and a query adds what its sharing names weigh more.
    Names are grouped by their set of segments on both sides first, so equal names meet once.
    Queries without a name share nothing with any.
    """
    kept = lambda c: F.array_sort(F.array_distinct(segment_name(F.col(c))))
    groups = candidates.select(kept(candidate_name).alias("segments"), vector)
    groups = checkpointed(sum_arrays(groups, ["segments"], vector, size, "vec", "n"))
    asked = checkpointed(queries.select(id_col, F.coalesce(kept(name), F.array().cast("array<string>")).alias("asked")))
    of_query = asked.select("asked").distinct().select("asked", F.explode("asked").alias("segment"))
    of_group = groups.select(F.xxhash64("segments").alias("g"), F.explode("segments").alias("s"))
    shared = of_query.join(of_group, F.col("segment") == F.col("s")).groupBy("asked", "g").agg(F.count("*").alias("shared"))
    more = shared.join(groups.select(F.xxhash64("segments").alias("h"), "vec", "n"), F.col("g") == F.col("h"))
    excess = F.exp(F.col("shared") * sharpness) - 1
    added = sum_arrays(more.select("asked", F.transform(F.concat("vec", F.array(F.col("n").cast("double"))), lambda x: x * excess).alias("x")), ["asked"], "x", size + 1, "more")
    whole = groups.agg(*[F.coalesce(F.sum(F.get("vec", F.lit(i))), F.lit(0.0)).alias(f"_{i}") for i in range(size)], F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(f"_{size}"))
    rows = asked.join(added.withColumnRenamed("asked", "_a"), F.col("asked") == F.col("_a"), "left").join(F.broadcast(whole))  # one row
    more_of = lambda i: F.coalesce(F.get("more", F.lit(i)), F.lit(0.0))
    weight = F.exp(F.lit(float(guardian)))
    total = F.col(f"_{size}") + more_of(size) + weight
    return rows.select(id_col, F.array(*[(F.col(f"_{i}") + more_of(i) + weight * float(default[i])) / total for i in range(size)]).alias("seen"))
