"""MinHash near-dedup with SetSketch registers.

A document is its set of word shingles.  A register is the least of one hash
over the set, taken as an exponential variable and truncated to a power of BASE:
registers of a union are the larger of two registers, and equal registers are as
likely as the sets are alike.  Documents that agree on all registers of a band
are candidates; a maximum-likelihood estimate of their similarity from all
registers (which of each pair is larger, or none) prunes them; full sets decide.

Documents with equal sets are one class.  A bucket does not give all its pairs:
within a piece of PIECE members, all are estimated and a maximum spanning forest
of the promising pairs is sent on, so pairs grow with members.  Larger buckets
are cut into random pieces, other ones in each band.  When these links are
confirmed, buckets that still hold documents of different components are
searched again for every promising pair across them, with the members outside a
bucket's largest component in all its pieces.  That search has the members' sets
with it and sends on only what is linked by them; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_map import map_batches, map_stream
from .common import cut, likely_in, sealed, sweep
from .components import connected_components
from .textscan import mix, random_values, shingle_set

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE = 1.001
#: Estimates below that are not verified: four standard errors under the limit.
PROMISING = 0.6
PIECE = 256
#: Rows that those at home in a piece are compared with at a time.
STRIP = 4096
MULTIPLIERS = random_values(REGISTERS, 103)
GRID = np.linspace(0.02, 1.0, 50)


def registers(shingles: np.ndarray) -> np.ndarray:
    """REGISTERS 16-bit registers: the truncated logarithm, in steps of BASE, of the least exponential variable, growing as it falls."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * MULTIPLIERS).min(axis=0), out=least)
    exponential = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 1e-16))
    return np.clip(np.floor(30_000 - np.log(exponential) / math.log(BASE)), 0, 65_535).astype(np.uint16)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


def joint_estimate(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities, on GRID, from how many of a's registers are
    larger and smaller than b's and from the sizes of the sets."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(GRID, np.minimum(u / v, v / u))
    up, down = _p(u - v * j), _p(v - u * j)
    tiny = 1e-9
    like = larger[:, None] * np.log(up + tiny) + smaller[:, None] * np.log(down + tiny) + (REGISTERS - larger - smaller)[:, None] * np.log(np.maximum(1 - up - down, 0) + tiny)
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], axis=1)[:, 0]


def sized_pairs(n: np.ndarray, comp: np.ndarray | None, guest: np.ndarray | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose sizes allow a link, each once: rows at home against strips of all rows.

    comp: only pairs of different components; guest: not pairs of two guests.  No
    more than PIECE x STRIP cells are looked at together, however many rows there are.
    """
    home = np.arange(len(n)) if guest is None else np.flatnonzero(~guest)
    for h in range(0, len(home), PIECE):
        i = home[h : h + PIECE, None]
        for s in range(0, len(n), STRIP):
            j = np.arange(s, min(s + STRIP, len(n)))[None, :]
            near = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            near &= (i < j) if guest is None else (i < j) | guest[j]
            if comp is not None:
                near &= comp[i] != comp[j]
            a, b = np.nonzero(near)
            yield i[a, 0], j[0, b]


def promising_pairs(regs: np.ndarray, n: np.ndarray, comp: np.ndarray | None = None, guest: np.ndarray | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, estimate) of the rows of regs whose sizes allow a link and whose estimate is promising."""
    keep_i, keep_j, keep_e = [], [], []
    for i, j in sized_pairs(n, comp, guest, percent):
        for at in range(0, len(i), 4096):
            a, b = i[at : at + 4096], j[at : at + 4096]
            ra, rb = regs[a], regs[b]
            equal = (ra == rb).sum(axis=1)
            some = equal >= 0.5 * PROMISING * REGISTERS  # cheap: equal registers alone must be near
            a, b, ra, rb = a[some], b[some], ra[some], rb[some]
            if len(a):
                e = joint_estimate((ra > rb).sum(axis=1), (ra < rb).sum(axis=1), n[a].astype(float), n[b].astype(float))
                good = e >= PROMISING
                keep_i.append(a[good])
                keep_j.append(b[good])
                keep_e.append(e[good])
    if not keep_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(keep_i), np.concatenate(keep_j), np.concatenate(keep_e)


def spanning_forest(size: int, i: np.ndarray, j: np.ndarray, e: np.ndarray) -> list[int]:
    """Indices of a maximum spanning forest of the pairs."""
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k in np.argsort(-e, kind="stable").tolist():
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b:
            root[a] = b
            out.append(k)
    return out


def marks(shingles: np.ndarray) -> tuple[int, int, int]:
    """Size and two 64-bit sums of a set; sets with equal marks are taken as equal."""
    a, b = np.array([shingles.sum(dtype=np.uint64), mix(shingles).sum(dtype=np.uint64)]).view(np.int64)
    return len(shingles), int(a), int(b)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (shingles), h1 and h2 (of the set), regs; one row per row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def make():
        def work(batch):
            sets = (shingle_set(text, WORDS) for text in batch.column(1).to_pylist())
            found = [(*marks(s), registers(s).tobytes() if len(s) else None) for s in sets]
            return {"id": batch.column(0)} | dict(zip(("n", "h1", "h2", "regs"), zip(*found, strict=True), strict=True))

        return work

    return map_batches(rows, make, "id bigint, n bigint, h1 bigint, h2 bigint, regs binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """rep, key, band: a row for each band of each class."""

    def make():
        def work(batch):
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            places = random_values(ROWS, 104)
            keys = mix((regs * places).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            return {"rep": np.repeat(batch.column("rep").to_numpy(), BANDS), "key": keys.ravel().view(np.int64), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(keys))}

        return work

    return map_batches(classes.select("rep", "regs"), make, "rep bigint, key bigint, band int")


def linked_across(regs: np.ndarray, i: np.ndarray, j: np.ndarray, band: int, heads: Callable[[int], np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which of the pairs meet first in this band and are linked by the upper halves of their hashes.

    Upper halves of different hashes are seldom equal, so a pair within two
    percent of the limit is kept for the full sets to decide.
    """
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 4096):
        a, b = regs[i[at : at + 4096]], regs[j[at : at + 4096]]
        out[at : at + 4096] = (a == b).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
    for k in np.flatnonzero(out):
        x, y = heads(i[k]), heads(j[k])
        common = len(np.intersect1d(x, y))
        out[k] = 100 * common >= (percent - 2) * (len(x) + len(y) - common)
    return out


def _search(members: DataFrame, across: bool) -> DataFrame:
    """Pairs (a, b) of members(key, band, piece, rep, n, regs[, comp, guest, heads]), bucket piece by bucket piece.

    across: all pairs of different components, of which not both are guests of
    the piece, that the upper halves of the hashes (heads) link.  Else a spanning
    forest of the promising pairs of each piece.
    """
    dealt = members.repartition("key", "piece").sortWithinPartitions("key", "piece", "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            rest = yield from pieces(t, False)
        if rest is not None and rest.num_rows:
            yield from pieces(rest, True)

    def pieces(t, last):
        t = t.combine_chunks()
        key, piece = t.column("key").to_numpy(), t.column("piece").to_numpy()
        edges = np.flatnonzero((key[1:] != key[:-1]) | (piece[1:] != piece[:-1])) + 1
        starts, ends = np.concatenate([[0], edges]).astype(int), np.concatenate([edges, [len(key)]]).astype(int)
        rest = None
        if not last:
            rest = t.slice(int(starts[-1]))
            starts, ends = starts[:-1], ends[:-1]
        rep, n, band = (t.column(c).to_numpy() for c in ("rep", "n", "band"))
        comp, guest = (t.column(c).to_numpy() for c in ("comp", "guest")) if across else (None, None)
        out_a, out_b = [], []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a < 2:
                continue
            regs = np.frombuffer(b"".join(t.column("regs").slice(a, b - a).to_pylist()), np.uint16).reshape(b - a, REGISTERS)
            if across:
                i, j, e = promising_pairs(regs, n[a:b], comp[a:b], guest[a:b])
                packed = t.column("heads").slice(a, b - a).combine_chunks()
                heads = lambda k, packed=packed: np.frombuffer(packed[int(k)].as_buffer(), np.uint32)
                pick = linked_across(regs, i, j, int(band[a]), heads)
            else:
                i, j, e = promising_pairs(regs, n[a:b])
                pick = spanning_forest(b - a, i, j, e)
            out_a.append(rep[a:b][i[pick]])
            out_b.append(rep[a:b][j[pick]])
        if out_a:
            x, y = np.concatenate(out_a), np.concatenate(out_b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)
        return rest

    return map_stream(dealt, run, "a bigint, b bigint").distinct()


def upper_halves(sets: DataFrame) -> DataFrame:
    """rep, heads: the upper 32 bits of each hash."""

    def make():
        def work(batch):
            return {"rep": batch.column(0), "heads": [(np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column(1).to_pylist()]}

        return work

    return map_batches(sets.select("rep", "shingles"), make, "rep bigint, heads binary")


def shingle_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rep, shingles (packed sorted hashes) of classes(rep, owner, n, h1, h2), each from a document with id = owner.

    A bitmap keeps most texts that are not asked for out of the shuffle.
    """
    wanted = cut(classes.select("rep", "owner", "n", "h1", "h2"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(likely_in(wanted, "owner")(F.col("id")))

    def make():
        def work(batch):
            out = {"rep": [], "shingles": []}
            for t, rep, *want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(t, WORDS)
                if marks(s) == tuple(want):  # an id may have several texts
                    out["rep"].append(rep)
                    out["shingles"].append(s.tobytes())
            return out

        return work

    asked = rows.join(wanted.hint("shuffle_hash"), F.col("id") == F.col("owner")).select("t", "rep", "n", "h1", "h2")
    return map_batches(asked, make, "rep bigint, shingles binary").dropDuplicates(["rep"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=schema)

    return map_stream(both.select("a", "b", "sa", "sb"), run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """id_col, n_shingles, component_id, kept: one row per row of docs.

    Documents are linked if their sets of distinct WORDS-word shingles have
    100 * intersection >= PERCENT * union; words are in lower case (A-Z) and
    split at ASCII white space; a text with fewer words is one shingle.  Null,
    empty and blank texts are linked with nothing.  The banding finds a pair at
    the limit with a probability of 0.999995.  kept marks the smallest id of each
    component; rows that repeat an id count as one document, with the links of all
    its texts.  Ids are integers; rows with a null id are components of their own
    and kept.  Texts of any length are taken whole; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    sketched = cut(sketches(docs, id_col, text_col))
    named = sketched.where("n > 0 AND id IS NOT NULL")
    classes = named.groupBy("n", "h1", "h2").agg(F.min("id").alias("owner"), F.first("regs").alias("regs"))
    several = cut(named.groupBy("id").agg(F.min(F.struct("n", "h1", "h2")).alias("lo"), F.max(F.struct("n", "h1", "h2")).alias("hi")).where("lo <> hi").select(F.col("id").alias("several_id")))
    versions = not several.isEmpty()
    if versions:  # classes may share their smallest id: these get a negative number of their own
        shared_owner = classes.groupBy(F.col("owner").alias("o")).count().where("count > 1").select("o")
        own = -1 - F.shiftrightunsigned(F.xxhash64("owner", "n", "h1", "h2"), 1)
        classes = classes.join(shared_owner, F.col("owner") == F.col("o"), "left").withColumn("rep", F.when(F.col("o").isNull(), F.col("owner")).otherwise(own)).drop("o")
    else:
        classes = classes.withColumn("rep", F.col("owner"))
    classes = cut(classes.select("rep", "owner", "n", "h1", "h2", "regs"))
    keys = band_keys(classes)
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = cut(keys.join(shared, "key").select("key", "band", "rep", "members"))
    of_class = classes.select(F.col("rep").alias("r"), "n", "regs")
    pieces = F.ceil(F.col("members") / piece).cast("int")
    cell = F.pmod(F.xxhash64("rep", "key"), pieces).cast("int")
    members = shared.join(of_class, F.col("rep") == F.col("r")).select("key", "band", cell.alias("piece"), "rep", "n", "regs")
    pairs = cut(_search(members, across=False))
    facts_of = lambda ids: ids.join(classes.select("rep", "owner", "n", "h1", "h2"), "rep")
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = cut(shingle_sets(docs, facts_of(ids), id_col, text_col))
    links = cut(verified(pairs, sets))
    components = cut(connected_components(links))
    sweep(docs.sparkSession)
    # buckets that still hold several components
    labelled = shared.join(components.select(F.col("id").alias("c"), "component"), F.col("rep") == F.col("c"), "left").select("key", "band", "rep", "members", F.coalesce("component", "rep").alias("comp"))
    mixed = labelled.groupBy("key", "comp").agg(F.count("*").alias("n_comp")).groupBy("key").agg(F.max(F.struct("n_comp", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select(F.col("key").alias("k"), F.col("top.comp").alias("top"))
    open_ = cut(labelled.join(mixed, F.col("key") == F.col("k")).select("key", "band", "rep", "members", "comp", "top"))
    missing = open_.select("rep").distinct().join(sets.select("rep"), "rep", "left_anti")
    sets = sets.union(cut(shingle_sets(docs, facts_of(missing), id_col, text_col)))
    facts = of_class.join(upper_halves(sets), F.col("r") == F.col("rep")).select("r", "n", "regs", "heads")
    everywhere = F.when((F.col("comp") != F.col("top")) & (pieces > 1), F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(cell))
    spread = open_.withColumn("home", cell).withColumn("piece", F.explode(everywhere)).withColumn("guest", F.col("piece") != F.col("home"))
    spread = spread.join(facts, F.col("rep") == F.col("r")).select("key", "band", "piece", "rep", "n", "regs", "comp", "guest", "heads")
    more = cut(_search(spread, across=True).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    # the first components stand for the links that made them
    links = cut(components.select(F.col("id").alias("a"), F.col("component").alias("b")).union(verified(more, sets)))
    sweep(docs.sparkSession)
    owners = classes.select(F.col("rep").alias("c"), "owner", F.col("n").alias("kn"), F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    if versions:  # from classes to documents, and all classes of a document with one another
        renamed = cut(owners.where("c <> owner").select("c", "owner"))
        for end in ("a", "b"):
            links = links.join(renamed.withColumnRenamed("owner", "as"), F.col(end) == F.col("c"), "left").withColumn(end, F.coalesce("as", end)).drop("c", "as")
        of_one = named.join(several, F.col("id") == F.col("several_id")).join(owners, (F.col("n") == F.col("kn")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
        links = cut(links.select("a", "b").union(of_one.select(F.col("id").alias("a"), F.col("owner").alias("b"))).distinct())
    components = cut(connected_components(links))
    sweep(docs.sparkSession)
    known = owners.drop("c").join(components.select(F.col("id").alias("c"), "component"), F.col("owner") == F.col("c"), "left").select("kn", "k1", "k2", F.coalesce("component", "owner").alias("component"))
    joined = sketched.select("id", "n", "h1", "h2").join(known, (F.col("n") == F.col("kn")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id; all columns as they are, whatever their names.

    Rows that `near_duplicates` drops are found by their ids, and a bitmap of
    those ids lets most other texts stay where they are.  Of rows that repeat an
    id, which count as one document, that of the least hash of the text (then of
    the row) stays.  Rows without words or without an id stay; an empty table
    gives no rows.
    """
    rows = sealed(docs)
    key, text = (F.col(f"k{docs.columns.index(c)}") for c in (id_col, text_col))
    judged = cut(near_duplicates(docs, id_col, text_col).select(F.col(id_col).cast("bigint").alias("judged_id"), "kept"))
    dropped = judged.where("NOT kept").select("judged_id").distinct()
    again = judged.where("kept AND judged_id IS NOT NULL").groupBy("judged_id").count().where("count > 1").select("judged_id")
    likely = F.coalesce(likely_in(dropped.union(again), "judged_id")(key), F.lit(False))
    rest = rows.where(likely).join(dropped, key == F.col("judged_id"), "left_anti")
    if not again.isEmpty():
        hashed = [f"k{i}" for i, f in enumerate(docs.schema.fields) if f.dataType.typeName() != "map"]
        order = F.struct(F.xxhash64(text), F.md5(text), F.xxhash64(*hashed))
        rest = rest.groupBy(key.alias("group")).agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")
    return rows.where(~likely).unionByName(rest).toDF(*docs.columns)
