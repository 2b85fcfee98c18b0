"""Fixpoints over edge lists: components, reachability, distances, levels, export resolution."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A side is broadcast only if a count has shown that it has no more rows than this.
BROADCAST_ROWS = 20_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in spark.checkpoint.dir.

    A temporary folder takes its place where that is unset, but only with a local master.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphspan-"))
    return df.checkpoint()


class Stored:
    """Tables of a loop as Parquet beside the checkpoints, which is much smaller than a checkpoint; one that is stored again takes the place of the old one."""

    def __init__(self, spark: SparkSession, name: str):
        checkpointed(spark.range(1))  # sets the folder if need be
        self.spark, self.folder = spark, f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        # how many rows a file of few bytes holds is not known, so none is broadcast by its size
        return self.spark.read.schema(df.schema).parquet(path).hint("merge")

    def drop(self, *names: str) -> None:
        for name in names or list(self.paths):
            if name in self.paths:
                self._delete(self.paths.pop(name))
        if not names:
            self._delete(self.folder)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files and checkpoints that nothing refers to; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else df as it is, for a join that shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that shuffles, whatever size Spark expects of it.

    Spark takes rows that are parsed or exploded to be no more than those they come from, and would send
    them all through the driver to broadcast them.
    """
    return df.hint("merge")


def equality_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node that equalities connect it with.

    Each round takes the least label of the neighbours and then the label of
    that label, so long chains take a logarithmic number of rounds.
    """
    links = checkpointed(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = checkpointed(links.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", F.coalesce("least", "component")).alias("component"))
        jump = step.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        new = checkpointed(step.join(jump, F.col("component") == F.col("n2")).select("node", F.least("component", "c2").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        labels = new
        release(edges.sparkSession)
        if not changed:
            return labels


def reachable(edges: DataFrame, seeds: DataFrame, stop: DataFrame | None = None, undirected: bool = False) -> DataFrame:
    """node, hops: nodes that walks from the seeds reach and the least number of edges.

    edges(src, dst), seeds(node).  Nodes in stop(node) are reached but not left.
    """
    if undirected:
        edges = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    edges = checkpointed(edges.select("src", "dst").distinct())
    found = frontier = checkpointed(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    hops = 0
    while True:
        hops += 1
        from_ = frontier if stop is None else frontier.join(stop.select("node"), "node", "left_anti")
        new = edges.join(from_, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(new.join(found, "node", "left_anti").withColumn("hops", F.lit(hops)))
        if frontier.isEmpty():
            return found
        # each round is written once; only now and then are they put together
        found = found.union(frontier)
        if hops % 16 == 0:
            found = checkpointed(found)


def topological_levels(edges: DataFrame) -> DataFrame:
    """node, level: the longest way from a node without predecessors, of an acyclic graph edges(src, dst)."""
    edges = checkpointed(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    levels = None
    frontier = checkpointed(nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(0)))
    k = 0
    while not frontier.isEmpty():
        levels = frontier if levels is None else levels.union(frontier)
        k += 1
        if k % 16 == 0:
            levels = checkpointed(levels.groupBy("node").agg(F.max("level").alias("level")))
        frontier = checkpointed(edges.join(frontier, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), F.lit(k).alias("level")).distinct())
    return levels if levels is None else levels.groupBy("node").agg(F.max("level").alias("level"))


def resolve_exports(own: DataFrame, reexports: DataFrame, rounds: int | None = None) -> DataFrame:
    """module, symbol, origin: exports through chains of any length (or so many rounds).

    own(module, symbol, origin); reexports(module, from_module).  A module's own
    symbols win over re-exported ones; of several re-exports the last origin wins.
    Rounds go on until nothing changes: chains and cycles end, as origins only grow.
    """
    own = checkpointed(own.select("module", "symbol", "origin"))
    exports = own
    while rounds is None or rounds > 0:
        passed = reexports.join(exports.withColumnRenamed("module", "from_module"), "from_module").select("module", "symbol", "origin").groupBy("module", "symbol").agg(F.max("origin").alias("origin"))
        new = checkpointed(own.union(passed.join(own.select("module", "symbol"), ["module", "symbol"], "left_anti")))
        if new.exceptAll(exports).isEmpty() and exports.exceptAll(new).isEmpty():
            break
        exports = new
        rounds = None if rounds is None else rounds - 1
    return exports


def longest_prefix(paths: DataFrame, aliases: DataFrame, path: str = "path") -> DataFrame:
    """paths with the alias(prefix, target) of their longest prefix by segments, null if none fits.

    Every path gives its prefixes and meets aliases by equality, not by starting with them.
    """
    segments = F.split(F.col(path), "/")
    prefixes = paths.select(path).distinct().select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))).alias("prefix"))
    hit = prefixes.join(aliases, "prefix").groupBy(path).agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("hit"))
    return paths.join(hit.select(path, "hit.prefix", "hit.target"), path, "left")
