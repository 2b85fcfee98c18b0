"""Numbers and folds along one order of a whole table, without one task that sees it all.

Rows are cut into ranges of the order; each range is sorted in its own task.  What
stands before a range follows from one row per range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, small


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """df sorted along the order, range by range, with the number of the range as `_piece`; behind a checkpoint, so ranges stay as they are."""
    return checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_piece", F.spark_partition_id()))


def running(df: DataFrame, order: list[str | Column], totals: dict[str, Column]) -> DataFrame:
    """df with, for each name of totals, the sum of its column over all rows before the row in the order (ties in any order)."""
    pieces = in_ranges(df.select("*", *[c.alias(f"_{n}") for n, c in totals.items()]), *order)
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy("_piece").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in totals])  # one row per range
    starts = small(sums.select(F.col("_piece").alias("_p"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in totals]))
    within = Window.partitionBy("_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.join(starts, F.col("_piece") == F.col("_p"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_start_{n}") + F.coalesce(F.sum(f"_{n}").over(within), F.lit(0))).alias(n) for n in totals])


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """df with its place in the order, from start."""
    return running(df, order, {name: F.lit(1)}).withColumn(name, F.col(name) + start)


def _by_key(frames: Iterator[pd.DataFrame], key: str, value: str) -> Iterator[tuple[object, np.ndarray, bool]]:
    """(key, values, whether these are the key's first in this range) of sorted frames, piece by piece."""
    last = object()
    for frame in frames:
        keys = frame[key].to_numpy()
        if not len(keys):
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            yield keys[a], frame[value].to_numpy(float)[a:b], keys[a] != last
            last = keys[a]


def affine_fold(pieces: DataFrame, key: str, value: str, steps: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]], kind: str) -> DataFrame:
    """key, n, state: what x -> a x + b makes of 0, step by step along the rows of each key of in_ranges(df, key, ..).

    steps(t, values): the arrays a and b of the steps after the first t of a key.
    A key of any length is folded range by range in bounded memory: first ranges
    are counted, then each gives its own a and b, which are put together in order.
    """
    counts = pieces.groupBy("_piece", key).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a range starts with at most one key that an earlier range has begun
    starts = {r["_piece"]: (r[key], r["t"]) for r in counts.withColumn("t", before).where("t > 0").select("_piece", key, "t").collect()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, now, piece = [], None, None

        def tagged():
            nonlocal piece
            for frame in frames:
                if len(frame):
                    piece = int(frame["_piece"].iloc[0])
                yield frame

        for k, values, first in _by_key(tagged(), key, value):
            if first:
                if now is not None:
                    rows.append(now)
                t = starts[piece][1] if piece in starts and starts[piece][0] == k else 0
                now = [piece, k, t, t, 1.0, 0.0]
            a, b = steps(now[3], values)
            # what the steps from one on still multiply
            left = np.concatenate([np.cumprod(a[::-1])[::-1][1:], [1.0]])
            whole = float(left[0] * a[0])
            now[5] = now[5] * whole + float((left * b).sum())
            now[4] *= whole
            now[3] += len(values)
        if now is not None:
            rows.append(now)
        yield pd.DataFrame(rows, columns=["_piece", key, "_from", "_to", "_a", "_b"])

    parts = pieces.select("_piece", key, value).mapInPandas(run, f"_piece int, {key} {kind}, _from bigint, _to bigint, _a double, _b double")
    ordered = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_a", "_b"))).alias("p"))  # one entry per range of the key
    return ordered.select(key, F.element_at("p", -1)["_to"].alias("n"), F.aggregate("p", F.lit(0.0), lambda x, s: x * s["_a"] + s["_b"]).alias("state"))


def adam_moves(pieces: DataFrame, key: str, value: str, kind: str, lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """key, moved: the change of a parameter over the gradients of each key of in_ranges(df, key, ..), by bias-corrected Adam.

    Both moments are linear in where they start, so ranges are folded on their
    own first; then each range adds up its changes from the moments before it.
    """

    def local(frames):
        rows, now, piece = [], None, None

        def tagged():
            nonlocal piece
            for frame in frames:
                if len(frame):
                    piece = int(frame["_piece"].iloc[0])
                yield frame

        for k, g, first in _by_key(tagged(), key, value):
            if first:
                if now is not None:
                    rows.append(now)
                now = [piece, k, 0, 0.0, 0.0]
            left = np.arange(len(g) - 1, -1, -1)
            now[3] = now[3] * b1 ** len(g) + float((g * (1 - b1) * b1**left).sum())
            now[4] = now[4] * b2 ** len(g) + float((g * g * (1 - b2) * b2**left).sum())
            now[2] += len(g)
        if now is not None:
            rows.append(now)
        yield pd.DataFrame(rows, columns=["_piece", key, "n", "m", "v"])

    rows = pieces.select("_piece", key, value)
    parts = rows.mapInPandas(local, f"_piece int, {key} {kind}, n bigint, m double, v double")
    again = Window.partitionBy(key)
    cut = parts.withColumn("ranges", F.count("*").over(again)).where("ranges > 1").collect()  # keys that go over a range's end: two a range at most
    starts: dict[int, tuple] = {}
    state: dict = {}
    for r in sorted(cut, key=lambda r: r["_piece"]):
        t, m, v = state.get(r[key], (0, 0.0, 0.0))
        if t:
            starts[r["_piece"]] = (r[key], t, m, v)
        state[r[key]] = t + r["n"], m * b1 ** r["n"] + r["m"], v * b2 ** r["n"] + r["v"]

    def moved(frames):
        rows, piece, now, at = [], None, None, (0, 0.0, 0.0)

        def tagged():
            nonlocal piece
            for frame in frames:
                if len(frame):
                    piece = int(frame["_piece"].iloc[0])
                yield frame

        for k, g, first in _by_key(tagged(), key, value):
            if first:
                if now is not None:
                    rows.append(now)
                at = starts[piece][1:] if piece in starts and starts[piece][0] == k else (0, 0.0, 0.0)
                now = [k, 0.0]
            t, m, v = at
            for x in g.tolist():
                t, m, v = t + 1, m * b1 + x * (1 - b1), v * b2 + x * x * (1 - b2)
                now[1] -= lr * (m / (1 - b1**t)) / ((v / (1 - b2**t)) ** 0.5 + eps)
            at = t, m, v
        if now is not None:
            rows.append(now)
        yield pd.DataFrame(rows, columns=[key, "moved"])

    return rows.mapInPandas(moved, f"{key} {kind}, moved double").groupBy(key).agg(F.sum("moved").alias("moved"))
