"""Embedding near-dedup: iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learnt on a bounded sample so that the signs
of the rotated axes are balanced codes; several rotations from different starts
give more bits.  The bits are cut into substrings, each of which addresses one
Hamming table.  How many tables there are follows from made-up pairs right at the
threshold: tables are added until enough of these pairs share an entry of one,
so the number fits the data, wherever its centre lies.  The same pairs say within
which Hamming distance of the whole codes a link may lie.

Only ids and packed codes are dealt out to the tables.  Rows of an entry that
have another row within that distance are candidates; their vectors are fetched
and compared by cosine in double precision.  A pair is counted in the first table
where it meets and nowhere else, and an entry returns sums and a spanning forest
of its links, so no rows grow with the number of pairs.  Equal vectors are one
class from the start.  Entries of more than BLOCK rows are compared block by
block, in as many tasks as there are pairs of blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_map import map_stream
from .common import cut, small, unit
from .components import connected_components

SAMPLE = 10_000
ROUNDS = 40
#: Rows of an entry that are compared at once; rows of the larger ones are copied once for each block.
BLOCK = 8192
#: Cosines that are held at once.
STRIP = 1 << 22
#: Share of the pairs right at the threshold that meet in some table.
RECALL = 0.995
#: Made-up pairs, half of them along differences of the sample's vectors.
PAIRS = 4000
#: Links of the sample are heeded if there are so many.
LEAST_PAIRS = 200
#: Vectors for each entry of a table, on average.
PER_ENTRY = 8
#: With more tables than that, substrings become shorter.
MANY_TABLES = 96
U64 = np.uint64


@dataclass
class Quantiser:
    """Codes of `tables` substrings of `width` bits each; links lie within `radius` bits of each other."""

    mean: np.ndarray
    axes: np.ndarray  # dimensions x bits
    width: int
    tables: int
    radius: int

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes > 0

    def codes(self, bits: np.ndarray) -> np.ndarray:
        """rows x tables: the substrings as numbers."""
        return bits.reshape(len(bits), self.tables, self.width) @ (1 << np.arange(self.width, dtype=np.int64))


def packed(bits: np.ndarray) -> np.ndarray:
    """rows x words of 64 bits."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(U64)


def itq_rotation(projected: np.ndarray, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """The rotation that brings the rows nearest to the corners of the cube: signs and rotation in turns."""
    d = projected.shape[1]
    r, _ = np.linalg.qr(rng.normal(size=(d, d)))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(projected @ r).T @ projected)
        r = (u @ v).T
    return r


def pairs_at(sample: np.ndarray, threshold: float, rng: np.random.Generator, n: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """n pairs with a cosine of threshold: rows of the sample and a step aside, in any direction or along a difference of two rows."""
    x = sample[rng.integers(0, len(sample), n)]
    step = rng.normal(size=x.shape)
    along = sample[rng.integers(0, len(sample), n // 2)] - sample[rng.integers(0, len(sample), n // 2)]
    some = np.linalg.norm(along, axis=1) > 1e-6
    step[: n // 2][some] = along[some]
    step -= (step * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(step, axis=1, keepdims=True)
    step = np.divide(step, size, out=np.zeros_like(step), where=size > 1e-9)
    return x, threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * step


def pairs_found(sample: np.ndarray, threshold: float, n: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Up to n pairs of rows of the sample that are links, but not near copies: they lie where vectors are dense, as real links do."""
    firsts, seconds = [np.zeros(0, int)], [np.zeros(0, int)]
    for at in range(0, len(sample), 256):
        if sum(map(len, firsts)) >= n:
            break
        close = sample[at : at + 256] @ sample[at:].T
        i, j = np.nonzero((close >= threshold) & (close < (1 + threshold) / 2))
        firsts.append(i[j > i] + at)
        seconds.append(j[j > i] + at)
    i, j = np.concatenate(firsts)[:n], np.concatenate(seconds)[:n]
    return sample[i], sample[j]


def learn_quantiser(sample: np.ndarray, rows: int, threshold: float, seed: int = 7) -> Quantiser:
    """sample: unit vectors; rows: how many vectors the tables are to hold."""
    d = sample.shape[1]
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    _, pca = np.linalg.eigh((sample - mean).T @ (sample - mean))
    projected = (sample - mean) @ pca
    made, found = pairs_at(sample, threshold, rng), pairs_found(sample, threshold)
    x, y = (np.concatenate(p) - mean for p in zip(made, found, strict=True))
    kinds = [slice(0, PAIRS // 2), slice(PAIRS // 2, PAIRS), *([slice(PAIRS, None)] if len(found[0]) >= LEAST_PAIRS else [])]
    axes: list[np.ndarray] = []  # one axis each, in the order in which tables take them
    same: list[np.ndarray] = []  # whether the pairs agree on it

    def more() -> None:
        a = (pca @ itq_rotation(projected, rng))[:, rng.permutation(d)]
        axes.extend(a.T)
        same.extend((((x @ a) > 0) == ((y @ a) > 0)).T)

    def tables_of(width: int) -> int:
        met = np.zeros(len(x), bool)
        tables = 0
        # all kinds of pairs must meet
        while min(met[k].mean() for k in kinds) < RECALL and tables < 4 * MANY_TABLES:
            while len(axes) < (tables + 1) * width:
                more()
            met |= np.logical_and.reduce(same[tables * width : (tables + 1) * width])
            tables += 1
        return tables

    width = int(np.clip(round(math.log2(max(2, rows / PER_ENTRY))), 6, 60))
    while (tables := tables_of(width)) > MANY_TABLES and width > 1:
        width -= 1
    if tables > MANY_TABLES:  # no number of tables would do: one entry holds all, which are compared block by block
        width = tables = 1
        axes[0] = np.zeros(d)
    n = tables * width
    apart = n - np.sum(same[:n], axis=0)
    return Quantiser(mean, np.column_stack(axes[:n]), width, tables, int(apart.max()) + 3)


def unit_rows(batch_column: pa.Array, dim: int) -> np.ndarray:
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def entry_edges(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    change = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    edges = np.flatnonzero(change) + 1
    return np.concatenate([[0], edges]).astype(np.int64), np.concatenate([edges, [len(columns[0])]]).astype(np.int64)


def with_neighbours(starts: np.ndarray, ends: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
    """Whether each row has another one of its entry within radius bits."""
    found = np.zeros(len(words), bool)
    size = ends - starts
    own = np.repeat(ends, size)
    for shift in range(1, int(size.max())):  # each row with the one so many places on, if that is in its entry
        i = np.flatnonzero(np.arange(len(words)) + shift < own)
        if not len(i):
            break
        near = np.bitwise_count(words[i] ^ words[i + shift]).sum(axis=1) <= radius
        found[i[near]] = True
        found[i[near] + shift] = True
    return found


def links_of_entry(x: np.ndarray, codes: np.ndarray, table: int, copies: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Within one entry of a table: for each row the number of vectors it links with (copies counted),
    and the row that stands for its links (a forest).  side: block of each row; then only pairs across count."""
    n = len(x)
    links, root = np.zeros(n, np.int64), np.arange(n)
    strip = max(1, STRIP // n)
    held_i, held_j = [], []
    for at in range(0, n, strip):
        linked = np.triu(x[at : at + strip] @ x.T >= threshold, at + 1)
        if side is not None:
            linked &= side[at : at + strip, None] != side[None, :]
        i, j = np.nonzero(linked)
        i += at
        for c in range(table):  # pairs that met in an earlier table count there
            later = codes[i, c] != codes[j, c]
            i, j = i[later], j[later]
        links += (np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)).astype(np.int64)
        held_i.append(i)
        held_j.append(j)
        if sum(map(len, held_i)) > STRIP or at + strip >= n:
            join_roots(root, np.concatenate(held_i), np.concatenate(held_j))
            held_i, held_j = [], []
    return links, root


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lower labels run along the links i - j until none changes."""
    while len(i):
        before = root.copy()
        low = np.minimum(root[i], root[j])
        for end in (i, j):
            np.minimum.at(root, root[end], low)
            np.minimum.at(root, end, low)
        root[:] = root[root]
        if (before == root).all():
            break


def cosine_links(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """id_col, n_links, component_id, kept: one row per row of vectors.

    Pairs of at least `threshold` by cosine are links; none below it is.  The
    tables find a link with a probability of RECALL at the threshold, more above
    it.  Null, zero and non-finite vectors, and those that are not as long as
    most, link with nothing and are components of their own.  Repeated ids with
    equal vectors count as different vectors; equal cosines need no order, and
    the smallest id of a component stands for it.  Rows without an id link like
    others and are kept; a component of such rows alone has no id.  An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = cut(rows.withColumn("ok", F.coalesce(finite, F.lit(False))).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(2), "v")))
    length = rows.where("ok").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = length["d"]
    rows = rows.withColumn("ok", F.col("ok") & (F.size("v") == dim))
    classes = cut(rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.count("*").alias("copies"), F.first("v").alias("v")))
    shared = cut(classes.groupBy(F.col("owner").alias("o")).count().where("count > 1").select("o"))
    # an id with several vectors, or vectors without an id: such classes get negative numbers of their own
    versions = not shared.isEmpty() or not classes.where("owner IS NULL").isEmpty()
    own = -1 - F.shiftrightunsigned(F.xxhash64("owner", "h1", "h2"), 1)
    key = F.when(F.col("o").isNull() & F.col("owner").isNotNull(), F.col("owner")).otherwise(own) if versions else F.col("owner")
    classes = (classes.join(shared, F.col("owner").eqNullSafe(F.col("o")), "left") if versions else classes).withColumn("rep", key).drop("o")
    classes = cut(classes) if versions else classes
    drawn = classes.select("v", unit(F.col("rep"), 3).alias("u"), "rep").orderBy("u", "rep").limit(sample).select("v").toArrow()
    quantiser = learn_quantiser(unit_rows(drawn.column("v").combine_chunks(), dim), classes.count(), threshold)

    def to_codes(batches):
        for batch in batches:
            if batch.num_rows:
                bits = quantiser.bits(unit_rows(batch.column("v"), dim))
                flat = pa.array(quantiser.codes(bits).ravel())
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, quantiser.tables, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column("rep"), codes, pa.array([w.tobytes() for w in packed(bits)], pa.binary())], names=["rep", "codes", "bits"])

    coded = cut(map_stream(classes.select("rep", "v"), to_codes, "rep bigint, codes array<bigint>, bits binary"))
    places = coded.select("rep", "bits", F.posexplode("codes").alias("table", "code"))
    crowded = places.groupBy("table", "code").agg(F.count("*").alias("n")).where(F.col("n") > block)
    crowded = small(cut(crowded.select(F.col("table").alias("t"), F.col("code").alias("c"))))
    of_crowded = (F.col("table") == F.col("t")) & (F.col("code") == F.col("c"))
    dealt = places.join(crowded, of_crowded, "left_anti").repartition("table", "code").sortWithinPartitions("table", "code")

    def candidates(batches):
        """Rows arrive sorted by entry; the last entry may go on in the next batch."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            starts, _ = entry_edges(whole.column("table").to_numpy(), whole.column("code").to_numpy())
            held = whole.slice(int(starts[-1]))
            yield from chosen(whole.slice(0, int(starts[-1])))
        if held is not None:
            yield from chosen(held)

    def chosen(t: pa.Table):
        if t.num_rows < 2:
            return
        table, code, rep = (t.column(c).to_numpy() for c in ("table", "code", "rep"))
        words = np.frombuffer(b"".join(t.column("bits").to_pylist()), U64).reshape(t.num_rows, -1)
        pick = with_neighbours(*entry_edges(table, code), words, quantiser.radius)
        if pick.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[pick]) for c in (table, code, rep)], names=["table", "code", "rep"])

    found = map_stream(dealt.select("table", "code", "rep", "bits"), candidates, "table int, code bigint, rep bigint")
    found = cut(found.unionByName(places.join(crowded, of_crowded, "left_semi").select("table", "code", "rep")))
    large = found.groupBy("table", "code").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = small(cut(large.select(F.col("table").alias("t"), F.col("code").alias("c"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))))
    entries = found.join(large, of_crowded, "left").select("table", "code", "rep", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    facts = classes.select(F.col("rep").alias("r"), "copies", "v").join(coded.select(F.col("rep").alias("r2"), "codes"), F.col("r") == F.col("r2")).drop("r2")
    entries = entries.join(facts, F.col("rep") == F.col("r")).drop("r")
    # a row of block b goes to the pairs of blocks (b, other), lower first
    own = F.pmod(F.xxhash64("rep", "table"), F.col("blocks")).cast("int")
    entries = entries.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entries = entries.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    sorted_ = entries.select("table", "code", "low", "high", "own", "rep", "copies", "v", "codes").repartition("table", "code", "low", "high").sortWithinPartitions("table", "code", "low", "high")
    out = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    keys = ("table", "code", "low", "high")

    def compare(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            starts, _ = entry_edges(*(whole.column(c).to_numpy() for c in keys))
            held = whole.slice(int(starts[-1]))
            yield from linked(whole.slice(0, int(starts[-1])))
        if held is not None:
            yield from linked(held)

    def linked(t: pa.Table):
        if t.num_rows < 2:
            return
        t = t.combine_chunks()
        table, low, high, rep, copies, own = (t.column(c).to_numpy() for c in ("table", "low", "high", "rep", "copies", "own"))
        v, c = (t.column(x).combine_chunks() if isinstance(t.column(x), pa.ChunkedArray) else t.column(x) for x in ("v", "codes"))
        parts = []
        for a, b in zip(*entry_edges(*(t.column(x).to_numpy() for x in keys)), strict=True):
            if b - a > 1:
                codes = c.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                links, root = links_of_entry(unit_rows(v.slice(a, b - a), dim), codes, int(table[a]), copies[a:b], own[a:b] if low[a] < high[a] else None, threshold)
                some = np.flatnonzero(links)
                if len(some):
                    parts.append((rep[a:b][some], links[some], rep[a:b][root[some]]))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], schema=out)

    links = cut(map_stream(sorted_, compare, "rep bigint, links bigint, root bigint"))
    components = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    totals = links.groupBy(F.col("rep").alias("rep_of")).agg(F.sum("links").alias("links"))
    if versions:  # the least id of a component, not the least number of a class
        named = components.join(classes.select("rep", "owner"), F.col("id") == F.col("rep")).groupBy(F.col("component").alias("c")).agg(F.min("owner").alias("least"))
        components = components.join(named, F.col("component") == F.col("c")).select("id", F.col("least").alias("component"))
    facts = classes.select("h1", "h2", "rep", "owner", "copies").join(totals, F.col("rep") == F.col("rep_of"), "left").join(components, F.col("rep") == F.col("id"), "left")
    facts = facts.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "owner").alias("component_id"))
    joined = rows.select("id", "ok", "h1", "h2").join(facts, F.col("ok") & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
