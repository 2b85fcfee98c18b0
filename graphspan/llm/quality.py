"""Quality classifier from compression with dictionaries.

One zstandard dictionary comes from good labelled text and one from bad.  A text
is compressed in blocks with either and with none.  Differences of two such sizes
over their sum, of the whole text and of its extreme blocks, say which kind it is
like; a logistic curve fitted on labelled rows that went into no dictionary
turns them into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_map import map_batches
from .common import cut, unit
from .labelled import TRAIN_ROWS, fit_logistic, labelled_texts, logistic, prior_weights
from .toxicity import score_texts

LEVEL = 3
DICT_BYTES = 112_640
#: Bytes that are compressed at once: in longer blocks a text's own repeats outweigh the dictionary.
BLOCK = 2048
#: Blocks that are trained on at once; its trainer wants a hundred times the dictionary.
GROUP_BLOCKS = 5000
FEATURES = 9
SCALE = 10.0


def blocks_of(data: bytes) -> list[bytes]:
    """Blocks of BLOCK bytes; a rest of less than a quarter goes with the block before it."""
    starts = range(0, max(1, len(data) - BLOCK // 4), BLOCK)
    return [data[i : i + BLOCK] if i != starts[-1] else data[i:] for i in starts]


def train_dictionary(blocks: list[bytes]) -> bytes:
    """A dictionary of DICT_BYTES at most; blocks under 8 bytes, which the trainer refuses, go as one with the last.

    Too few blocks to train on, or too like each other, are used as they are, each once.
    """
    tiny = b"".join(b for b in blocks if len(b) < 8)
    fit = [b for b in blocks if len(b) >= 8]
    if tiny:
        fit = [*fit[:-1], fit[-1] + tiny] if fit else [tiny]
    try:
        return zstandard.train_dictionary(DICT_BYTES, fit, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(fit))[-DICT_BYTES:]


def dictionary_of(blocks: DataFrame, group_blocks: int = GROUP_BLOCKS) -> bytes:
    """A dictionary from all of blocks(block, place), place being a hash that spreads them; without blocks, an empty one.

    Executors make one from each group of about group_blocks blocks; the blocks
    of these dictionaries are grouped in turn, until there is one group.  So no
    block is left out, and no task holds more than a group.
    """

    def train(group):
        made = train_dictionary([bytes(b) for b in group.sort_values(["u", "block"])["block"]])
        return pd.DataFrame({"dictionary": [made]})

    def cut_up():
        def work(batch):
            found = [b for d in batch.column(0).to_pylist() for b in blocks_of(d)]
            return {"block": found}

        return work

    while True:
        blocks = cut(blocks)
        groups = -(-blocks.count() // group_blocks)
        grouped = blocks.select("block", F.xxhash64(F.lit(5), "block").alias("u"), F.pmod("place", F.lit(max(1, groups))).alias("g"))
        made = grouped.groupBy("g").applyInPandas(train, "dictionary binary")
        if groups < 2:
            return b"".join(bytes(r[0]) for r in made.collect())
        blocks = map_batches(made, cut_up, "block binary").select("block", F.xxhash64(F.lit(6), "block").alias("place"))


@dataclass
class QualityModel:
    good: bytes = b""
    bad: bytes = b""
    curve: tuple[float, ...] = (0.0,) * (FEATURES + 1)

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "curve": self.curve, "_ready": None}

    def compressors(self):
        if self._ready is None:
            bare = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            made = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=d, **bare))
            self._ready = [*made, zstandard.ZstdCompressor(**bare)]
        return self._ready

    def features(self, text: str | None) -> tuple[float, ...]:
        """Normalised differences of the sizes raw, compressed, compressed with the good and with the bad dictionary.

        All are differences of two sizes over their sum: bad and good (whole, and
        the least and greatest of all blocks), each of these and none, raw and the
        smaller of these, raw and none (whole and greatest).
        """
        data = (text or "").encode("utf-8", "replace")
        if not data or not self.good or not self.bad:
            return (0.0,) * FEATURES
        blocks = blocks_of(data)
        g, d, p = (np.array([len(c.compress(b)) for b in blocks], dtype=float) for c in self.compressors())
        raw = np.array([len(b) + 12 for b in blocks], dtype=float)  # a frame takes so much
        apart = lambda a, b: (a - b) / (a + b)
        least = np.minimum(g, d)
        each = apart(d, g)
        whole = apart(d.sum(), g.sum()), apart(p.sum(), g.sum()), apart(p.sum(), d.sum()), apart(raw.sum(), min(g.sum(), d.sum())), apart(raw.sum(), p.sum())
        return *map(float, whole), float(each.min()), float(each.max()), float(apart(raw, least).max()), float(apart(raw, p).max())

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], dtype=float).reshape(-1, FEATURES) * SCALE
        return logistic(np.array(self.curve), x)


def fit_quality(sample: DataFrame, counts: dict[int, int]) -> QualityModel:
    """From id, label, t: about two thirds of each label make the dictionaries, the rest the curve.

    A dictionary is made from all blocks of those texts; the rest's texts give a
    row of features each.  Without both labels all scores are 0.5.
    """
    model = QualityModel()
    part = sample.withColumn("made_of", unit(F.col("id"), 9) < 2 / 3)

    def cut_up():
        def work(batch):
            out = {"block": [], "id": [], "n": []}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = blocks_of(t.encode("utf-8", "replace"))
                out["block"] += found
                out["id"] += [i] * len(found)
                out["n"] += range(len(found))
            return out

        return work

    def blocks(label: int) -> DataFrame:
        found = map_batches(part.where(F.col("made_of") & (F.col("label") == label)).select("id", "t"), cut_up, "block binary, id bigint, n int")
        return found.select("block", F.xxhash64("id", "n").alias("place"))  # equal blocks spread, too

    by = {v: dictionary_of(blocks(v)) for v in (0, 1)}
    if not by[0] or not by[1]:
        return model
    model.good, model.bad = by[1], by[0]

    def measure():
        def work(batch):
            return {"label": batch.column(0), "id": batch.column(1), "x": [model.features(t) for t in batch.column(2).to_pylist()]}

        return work

    seen = lambda rows: sorted(tuple(r) for r in map_batches(rows.select("label", "id", "t"), measure, "label int, id bigint, x array<double>").collect())
    rest = seen(part.where("NOT made_of"))
    if len({r[0] for r in rest}) < 2:  # too few rows to set any aside
        rest = seen(part)
    y = np.array([r[0] for r in rest], dtype=float)
    x = np.array([r[2] for r in rest]) * SCALE
    model.curve = tuple(fit_logistic(x, y, prior_weights(y, counts)))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: list[str] | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """keep (default: id_col) and score in [0, 1], one row per row of docs.

    The model is fitted on at most train_rows labelled rows of each label for
    which `usable` holds, chosen by their ids; every whole text is scored.  Null
    and empty texts get the score of no difference.  Equal texts get equal scores,
    an empty table no rows.  No other column of docs is read, whatever its name.
    """
    model = fit_quality(*labelled_texts(docs, labels, label_col, usable, id_col, text_col, train_rows))
    return score_texts(docs, model, id_col, text_col, keep)
