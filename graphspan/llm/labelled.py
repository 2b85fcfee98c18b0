"""Bounded samples of labelled documents, and logistic calibration.

The sample's texts stay on the executors, behind a checkpoint; the driver sees
ids, labels and what a fit needs of each text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_map import map_batches
from .common import cut, unit
from .textscan import mix, random_values, shingle_set

#: Rows of each label that a classifier is fitted on.
TRAIN_ROWS = 3000
#: Bands of two registers by which labelled texts are found to be copies of one another.
BANDS = 8
SEEDS = random_values(2 * BANDS, 105)


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """id, label, t (whole text) of at most `rows` labelled documents of each label
    for which `usable` (of id_col) holds, and how many labelled ids each label has.

    The choice depends on the ids alone, so no text is left out for its length.
    Ids with both labels count as 1; labels other than 0 and 1, null ids and null
    texts are ignored.  Of an id with several texts the one with the least hash counts.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & usable).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    known = known.select(F.col(id_col).alias("known_id"), "label", unit(F.col(id_col), 5).alias("u"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [known.where(F.col("label") == v).orderBy("u", "known_id").limit(rows) for v in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]).select("known_id", "label"))  # 2 * rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    found = texts.join(chosen, F.col("id") == F.col("known_id")).groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("t"), F.col("t")))["t"].alias("t"))
    return cut(found), counts


def shares_of_copies(sample: DataFrame) -> dict[int, float]:
    """id -> 1 / the number of sampled texts that are copies, exact or near, of its text.

    Each of them then counts as a part of one text.  Texts that agree on a band of
    two minima of their five-word shingles are copies of one another.
    """

    def make():
        def work(batch):
            keys = []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t)
                least = np.array([mix(s ^ seed).min() for seed in SEEDS]) if len(s) else np.zeros(2 * BANDS, np.uint64)
                keys.append(mix(least[::2] + mix(least[1::2])).view(np.int64))
            return {"id": batch.column(0), "keys": keys}

        return work

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first: dict[tuple[int, int], int] = {}
    for i, keys in sorted(map_batches(sample.select("id", "t"), make, "id bigint, keys array<bigint>").collect()):
        root[i] = i
        for k in enumerate(keys):
            root[find(i)] = find(first.setdefault(k, i))
    size: dict[int, int] = {}
    for i in root:
        size[find(i)] = size.get(find(i), 0) + 1
    return {i: 1 / size[find(i)] for i in root}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Coefficients (the constant first) of a ridge logistic regression over standardised columns.

    Newton steps, halved until the penalised likelihood rises: it is concave, so this ends at its top.
    """
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - middle) / spread])
    penalty = np.full(z.shape[1], ridge)

    def value(b: np.ndarray) -> float:
        u = z @ b
        return float((weight * (y * u - np.logaddexp(0, u))).sum() - 0.5 * (penalty * b * b).sum())

    b = np.zeros(z.shape[1])
    now = value(b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (y - p)) - penalty * b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        while (new := value(b + step)) < now and np.abs(step).max() > 1e-9:
            step = step / 2
        if new <= now + 1e-9:
            break
        b, now = b + step, new
    slopes = b[1:] / spread
    return np.concatenate([[b[0] - (slopes * middle).sum()], slopes])


def logistic(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(b[0] + x @ b[1:], -30, 30)))


def prior_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give a sample of equal class sizes the class shares of all labelled rows."""
    share = {v: counts.get(v, 0) / max(1, sum(counts.values())) for v in (0, 1)}
    own = {v: max(1, int((y == v).sum())) / max(1, len(y)) for v in (0, 1)}
    return np.where(y == 1, share[1] / own[1], share[0] / own[0])
