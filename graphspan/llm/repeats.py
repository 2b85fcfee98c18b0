"""Repeated passages by depth-limited radix sorting of suffixes.

A suffix matters only through its first DEPTH bytes: suffixes that agree so far
form a group, and groups of two or more are the repeated windows.  Sorting every
suffix of the corpus would shuffle many times its size, so the most significant
digit is taken at chosen suffixes only:

* Pass 1.  Among the DIGIT-byte strings inside a window, the one with the least
  hash (the first of equals) is the window's anchor.  Equal windows have equal
  anchors at equal offsets, so windows are grouped by anchor.  Groups with one
  anchor occurrence hold no repeated window and are dropped.
* Pass 2.  Occurrences whose whole extents (all windows that belong to the
  anchor) are equal are repeated as a whole.
* Pass 3.  Where extents differ, the windows of a group are ordered to full depth.
  All contain the anchor, so the repeated ones cover one stretch, from the first
  to the last.  Small groups are sorted inside a task; windows of groups larger
  than a task's even share are counted one by one across the cluster.

No pass looks at pairs of occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_map import map_batches, map_stream
from .common import cut, likely_in
from .textscan import BYTES, mix, powers, stretch_hashes, sums

DEPTH = 400
DIGIT = 100
#: Anchor occurrences of one group that a task sorts, at least and at most.
TASK_LEAST, TASK_MOST = 256, 8192
#: Windows that are scanned at once; a power of two, so that a position fits the low bits of a packed hash.
STRIP = 1 << 19
U64 = np.uint64


def anchors(data: np.ndarray, depth: int = DEPTH, digit: int = DIGIT) -> tuple[np.ndarray, ...]:
    """Anchor positions, first and last window start that belong to each, hash of the digit, hash of the extent."""
    found = []
    for at in range(0, max(0, len(data) - depth + 1), STRIP):
        piece = data[at : at + STRIP + depth - 1]
        s = sums(piece)
        h = stretch_hashes(s, np.arange(len(piece) - digit + 1), np.arange(digit, len(piece) + 1))
        place = U64(2 * STRIP - 1)
        packed = (h & ~place) | np.arange(len(h), dtype=U64)
        w = depth - digit + 1
        rows = -(-len(packed) // w)
        grid = np.full(rows * w, np.iinfo(np.uint64).max, U64)
        grid[: len(packed)] = packed
        grid = grid.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        owner = (np.minimum(behind[: len(packed) - w + 1], ahead[w - 1 : len(packed)]) & place).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        last = np.concatenate([first[1:], [len(owner)]]) - 1
        p = owner[first]
        extent = stretch_hashes(s, first, last + depth) ^ mix((p - first).astype(U64) + U64(1))
        found.append((p + at, first + at, last + at, h[p], extent))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated_span(text: np.ndarray, starts: np.ndarray, group: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int = DEPTH, digit: int = DIGIT) -> tuple[np.ndarray, np.ndarray]:
    """First and last repeated window start of each occurrence (first > last: none).

    Occurrence i has the bytes of its windows at text[starts[i]:starts[i + 1]], an
    anchor at p, windows from lo to hi; occurrences with one group value are compared.
    """
    reach = depth - digit
    n = len(p)
    grid = np.zeros((n, reach + depth), np.uint8)
    column = np.arange(len(text)) - np.repeat(starts[:-1], np.diff(starts)) + np.repeat(reach - (p - lo), np.diff(starts))
    grid[np.repeat(np.arange(n), np.diff(starts)), column] = text
    s = np.zeros((n, reach + depth + 1), U64)
    np.cumsum(BYTES[grid] * powers(reach + depth)[0], axis=1, out=s[:, 1:])
    offset = np.arange(-reach, 1)
    window = s[:, depth : depth + reach + 1] - s[:, : reach + 1]
    keys = mix(window + (mix(group)[:, None] ^ mix(np.arange(reach + 1, dtype=U64) + U64(77))))
    i, o = np.nonzero((offset >= (lo - p)[:, None]) & (offset <= (hi - p)[:, None]))
    values = keys[i, o]
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    again = np.zeros(len(values), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    at = p[i[again]] + offset[o[again]]
    np.minimum.at(first, i[again], at)
    np.maximum.at(last, i[again], at)
    return first, last


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _with_text(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows(id, h, t) that wanted(id, h, items) names, each (id, h) once, with its items.

    A bitmap of the wanted ids keeps most other texts out of the shuffle.
    """
    named = wanted.select(F.col("id").alias("wid"), F.col("h").alias("wh"), "items").hint("shuffle_hash")
    likely = rows.where(likely_in(wanted, "id")(F.col("id")))
    found = likely.join(named, (F.col("id") == F.col("wid")) & (F.col("h") == F.col("wh"))).select("id", "h", "t", "items")
    return found.dropDuplicates(["id", "h"])


def _extents(named: DataFrame) -> DataFrame:
    """k, id, h, p, lo, hi, bytes of each named occurrence."""

    def make():
        def work(batch):
            out = {c: [] for c in ("k", "id", "h", "p", "lo", "hi", "bytes")}
            for i, h, t, items in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "t", "items")), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                for x in items:
                    for name, value in zip(out, (x["k"], i, h, x["p"], x["lo"], x["hi"], data[x["lo"] : x["hi"] + DEPTH]), strict=True):
                        out[name].append(value)
            return out

        return work

    return map_batches(named, make, "k bigint, id bigint, h bigint, p bigint, lo bigint, hi bigint, bytes binary")


def _sorted_in_tasks(extents: DataFrame) -> DataFrame:
    """id, h, first, last of the occurrences of groups that fit a task."""
    dealt = extents.repartition("k").sortWithinPartitions("k")
    schema = pa.schema([(c, pa.int64()) for c in ("id", "h", "first", "last")])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
            k = t.column("k").to_numpy()
            at = int(np.searchsorted(k, k[-1]))  # sorted: the last group may go on
            rest = t.slice(at)
            if at:
                yield from solved(t.slice(0, at))
        if rest is not None and rest.num_rows:
            yield from solved(rest)

    def solved(t):
        k = t.column("k").to_numpy()
        at = 0
        while at < len(k):  # whole groups, some thousand occurrences at once
            end = min(at + TASK_LEAST * 4, len(k))
            end = len(k) if end == len(k) else int(np.searchsorted(k, k[end - 1], side="right"))
            part = t.slice(at, end - at).combine_chunks()
            at = end
            group, i, h, p, lo, hi = (part.column(c).to_numpy() for c in ("k", "id", "h", "p", "lo", "hi"))
            pieces = part.column("bytes").to_pylist()
            starts = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
            first, last = repeated_span(np.frombuffer(b"".join(pieces), np.uint8), starts, group.view(np.uint64), p, lo, hi)
            some = last >= first
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (i, h, first, last)], schema=schema)

    return map_stream(dealt, run, "id bigint, h bigint, first bigint, last bigint")


def _counted_apart(named: DataFrame) -> DataFrame:
    """The same for groups that do not fit a task: a row for each window, counted by group, offset and hash."""

    def make():
        def work(batch):
            out = {c: [] for c in ("k", "o", "w", "id", "h", "p")}
            for i, h, t, items in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "t", "items")), strict=True):
                data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
                for x in items:
                    starts = np.arange(x["hi"] - x["lo"] + 1)
                    own = stretch_hashes(sums(data[x["lo"] : x["hi"] + DEPTH]), starts, starts + DEPTH)
                    n = len(starts)
                    for name, value in (("k", x["k"]), ("id", i), ("h", h), ("p", x["p"])):
                        out[name].append(np.full(n, value, np.int64))
                    out["o"].append(starts + x["lo"] - x["p"])
                    out["w"].append(own.view(np.int64))
            return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}

        return work

    windows = map_batches(named, make, "k bigint, o bigint, w bigint, id bigint, h bigint, p bigint")
    often = windows.groupBy("k", "o", "w").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("k2"), F.col("o").alias("o2"), F.col("w").alias("w2"))
    hits = windows.join(often, (F.col("k") == F.col("k2")) & (F.col("o") == F.col("o2")) & (F.col("w") == F.col("w2")))
    return hits.groupBy("id", "h", "p").agg((F.min("o") + F.col("p")).alias("first"), (F.max("o") + F.col("p")).alias("last")).select("id", "h", "first", "last")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """rows(id, h, t) -> id, h, spans: array of (lo, hi) byte ranges, unsorted and overlapping, that repeated windows cover."""

    def make():
        def work(batch):
            out = {c: [] for c in ("k", "f", "id", "h", "p", "lo", "hi")}
            for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "t")), strict=True):
                p, lo, hi, k, f = anchors(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))
                for name, value in (("k", k.view(np.int64)), ("f", f.view(np.int64)), ("id", np.full(len(p), i)), ("h", np.full(len(p), h)), ("p", p), ("lo", lo), ("hi", hi)):
                    out[name].append(value)
            return {c: np.concatenate(v) for c, v in out.items()}

        return work

    found = map_batches(rows, make, "k bigint, f bigint, id bigint, h bigint, p bigint, lo bigint, hi bigint")
    # behind a checkpoint both sides of the join are plain shuffles, so that a frequent anchor can be split
    twice = cut(found.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("k2")))
    alive = cut(found.join(twice, F.col("k") == F.col("k2")).drop("k2"))
    # extents that are equal as a whole; one of them stands for all in pass 3
    extents = alive.groupBy("k", "f").agg(F.count("*").alias("m"), F.min(F.struct("id", "h", "p")).alias("one"))
    groups = cut(extents.groupBy("k").agg(F.count(F.when(F.col("m") == 1, 1)).alias("open"), F.count("*").alias("kinds")).where("open > 0 AND kinds > 1").select(F.col("k").alias("k3"), "kinds"))
    classes = cut(extents.join(groups, F.col("k") == F.col("k3"), "left").select(F.col("k").alias("k2"), F.col("f").alias("f2"), "m", "one", "kinds"))
    marked = alive.join(classes, (F.col("k") == F.col("k2")) & (F.col("f") == F.col("f2")))
    done = marked.where("m > 1").select("id", "h", F.col("lo").alias("first"), F.col("hi").alias("last"))
    stands = (F.col("m") == 1) | ((F.col("one.id") == F.col("id")) & (F.col("one.h") == F.col("h")) & (F.col("one.p") == F.col("p")))
    total = classes.where("kinds IS NOT NULL").count()
    share = int(min(TASK_MOST, max(TASK_LEAST, total // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    item = F.struct("k", "p", "lo", "hi")
    wanted = lambda cond: cut(marked.where(stands & F.col("kinds").isNotNull() & cond).groupBy("id", "h").agg(F.collect_set(item).alias("items")))
    small_groups = _sorted_in_tasks(_extents(_with_text(rows, wanted(F.col("kinds") <= share))))
    spans = done.unionByName(small_groups)
    large = wanted(F.col("kinds") > share)
    if not large.isEmpty():
        spans = spans.unionByName(_counted_apart(_with_text(rows, large)))
    # rows that repeat an id and a text give the same spans: each is kept once, before spans come together
    spans = spans.distinct()
    return spans.groupBy("id", "h").agg(F.collect_list(F.struct(F.col("first").alias("lo"), (F.col("last") + DEPTH).alias("hi"))).alias("spans"))


def remove_spans(data: bytes, spans: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of data, and the maximal removed runs."""
    runs: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(data[at:lo])
        at = hi
    return b"".join([*kept, data[at:]]), [(lo, hi) for lo, hi in runs]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, runs (array of lo, hi: removed byte ranges) and kept_sha256: one row per row of docs.

    Every byte covered by a DEPTH-byte string that also starts elsewhere, in the
    same text or another, is removed; all is judged on the input.  Null texts
    count as empty.  Texts shorter than DEPTH bytes stay whole; of two equal rows
    with longer texts each is removed as a whole.  Texts are taken whole, however
    long; an empty table gives no rows; other columns are ignored, whatever their
    names.
    """
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(-(1 << 63))).alias("id"), F.col(id_col).isNull().alias("null_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", _text_key(F.col("t")))
    spans = repeated_spans(rows.select("id", "h", "t")).select(F.col("id").alias("sid"), F.col("h").alias("sh"), "spans").hint("shuffle_hash")
    joined = rows.join(spans, (F.col("id") == F.col("sid")) & (F.col("h") == F.col("sh")), "left").select("id", "null_id", "t", "spans")

    def make():
        def work(batch):
            out = {c: [] for c in ("n_bytes", "runs", "kept_sha256")}
            for t, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                kept, runs = remove_spans(data, spans or [])
                out["n_bytes"].append(len(data))
                out["runs"].append([{"lo": lo, "hi": hi} for lo, hi in runs])
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            return {"id": batch.column(0), "null_id": batch.column(1)} | out

        return work

    out = map_batches(joined, make, "id bigint, null_id boolean, n_bytes bigint, runs array<struct<lo:bigint,hi:bigint>>, kept_sha256 string")
    return out.select(F.when(~F.col("null_id"), F.col("id")).alias(id_col), "n_bytes", "runs", "kept_sha256")
