"""Toxicity by maximum-scoring segments of token log-odds.

Words, and the first four or five letters of longer words for words not seen
often enough, get the log-odds of toxic against other labelled text under an
informative Dirichlet prior (a term's prior mass follows its share of the whole
sample).  Terms that stand out count so much, all others a small negative
drift.  One linear scan finds every maximal-scoring segment of a text.
Scores of segments in clean text follow an extreme-value law with rate
``lam`` and density ``k`` per token, so a segment of score s in a text of n tokens
counts ``lam * s - log(k * n)``; a logistic curve turns what a text's segments
count into a probability.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_map import map_batches
from .common import cut
from .labelled import TRAIN_ROWS, fit_logistic, labelled_texts, logistic, prior_weights, shares_of_copies

TOKEN = re.compile(r"[^\W\d_]+")
#: Prior mass as a share of all term counts.
PRIOR_SHARE = 0.1
#: Texts that have a term at least, copies counting as one, if they are toxic.
LEAST_DOCS = 4
DRIFT = 0.08


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def maximal_segments(scored: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, end, score) of a sequence in which
    the listed positions have the listed positive scores and all others -drift.

    Each candidate carries the running sum before and after it, and a link to the
    last earlier candidate with a lower sum before it.  A new one follows links to the nearest candidate with a
    lower sum before it than its own, and joins it as long as that one's sum after it is lower than its own.
    What a link passes over is never looked at again, so the scan is linear.
    """
    firsts: list[int] = []
    ends: list[int] = []
    befores: list[float] = []
    afters: list[float] = []
    links: list[int] = []
    total, at = 0.0, 0
    for position, score in scored:
        total -= drift * (position - at)
        first, before = position, total
        total += score
        at = position + 1
        j = len(firsts) - 1
        while True:
            while j >= 0 and befores[j] >= before:
                j = links[j]
            if j < 0 or afters[j] >= total:
                break
            first, before, onward = firsts[j], befores[j], links[j]
            for column in (firsts, ends, befores, afters, links):
                del column[j:]
            j = onward
        firsts.append(first)
        ends.append(at)
        befores.append(before)
        afters.append(total)
        links.append(j)
    return [(a, b, after - before) for a, b, before, after in zip(firsts, ends, befores, afters, strict=True)]


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1e-4
    curve: tuple[float, ...] = (-3.0, 0.0, 0.0)
    drift: float = DRIFT

    def __post_init__(self):
        self.heads = frozenset(w.lstrip("^")[:4] for w in self.weights)

    def weigh(self, word: str) -> float:
        """Of the word, else of its head."""
        get = self.weights.get
        return get(word) or (get("^" + word[:5]) or get("^" + word[:4]) or 0.0 if len(word) > 5 else 0.0)

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        heads, weigh = self.heads, self.weigh
        return maximal_segments([(i, s) for i, w in enumerate(words) if w[:4] in heads and (s := weigh(w))], self.drift)

    def worth(self, segments: list[float], size: int) -> tuple[float, float]:
        """What the scores of the segments of a text of so many tokens count: the best one, and all of them together."""
        chance = math.log(self.k * max(size, 20))
        worth = [max(0.0, self.lam * s - chance) for s in segments]
        return max(worth, default=0.0), math.log1p(sum(worth))

    def features(self, text: str | None) -> tuple[float, float]:
        words = tokens(text or "")
        return self.worth([s for _, _, s in self.passages(words)], len(words))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], dtype=float).reshape(-1, 2)
        return logistic(np.array(self.curve), x)


def terms(words: list[str]) -> set[str]:
    return {t for w in words for t in ((w, "^" + w[:5], "^" + w[:4]) if len(w) > 5 else (w,))}


def counted_terms(sample: DataFrame, shares: dict[int, float]) -> tuple[list[tuple[str, float, float]], float, float, float, float]:
    """Terms with the weights of the toxic and the clean texts that have them, if LEAST_DOCS toxic
    texts do, and the weights of all (text, term) pairs and all texts, toxic and clean.

    A text weighs 1 over the number of its copies in the sample, so a copied
    passage makes no chance term look frequent and no text is left out.
    """

    def make():
        def work(batch):
            y: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for i, label, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                for w in terms(tokens(t)):
                    y[w][label] += shares[i]
                y["\0"][label] += shares[i]  # all texts
            return {"term": list(y), "y0": [v[0] for v in y.values()], "y1": [v[1] for v in y.values()]}

        return work

    counts = map_batches(sample.select("id", "label", "t"), make, "term string, y0 double, y1 double").groupBy("term").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"))
    counts = cut(counts)
    n = counts.where(F.col("term") != "\0").agg(F.sum("y1"), F.sum("y0")).first()
    d = counts.where(F.col("term") == "\0").agg(F.sum("y1"), F.sum("y0")).first()
    tested = counts.where((F.col("term") != "\0") & (F.col("y1") >= LEAST_DOCS - 1e-9)).select("term", "y1", "y0").collect()
    return sorted(map(tuple, tested)), n[0] or 0.0, n[1] or 0.0, d[0] or 0.0, d[1] or 0.0


def term_log_odds(tested: list[tuple[str, float, float]], n1: float, n0: float, d1: float, d0: float) -> dict[str, float]:
    """Log-odds of the terms that more toxic texts have than chance allows.

    A term's signed root of the likelihood ratio has to reach what the largest of
    as many chance terms would.
    """
    z_least = math.sqrt(2 * math.log(max(2, len(tested)))) + 0.5
    out = {}
    for w, y1, y0 in tested:
        e1 = (y1 + y0) * d1 / (d1 + d0)
        if y1 > e1 and math.sqrt(2 * (y1 * math.log(y1 / e1) + (y0 * math.log(y0 / (y1 + y0 - e1)) if y0 else 0))) >= z_least:
            prior = PRIOR_SHARE * (y1 + y0) / (n1 + n0)
            a1, a0 = prior * n1, prior * n0
            out[w] = math.log((y1 + a1) / (n1 * (1 + PRIOR_SHARE) - y1 - a1)) - math.log((y0 + a0) / (n0 * (1 + PRIOR_SHARE) - y0 - a0))
    return {w: x for w, x in out.items() if x > 0}


def fit_toxicity(sample: DataFrame, counts: dict[int, int]) -> ToxicityModel:
    """A model from id, label, t; without texts of both labels it knows no toxic token.

    Terms are counted, and segments found, on the executors; the driver gets the
    terms that can be tested and the scores of each text's segments.
    """
    model = ToxicityModel()
    if {r[0] for r in sample.select("label").distinct().collect()} != {0, 1}:
        return model
    shares = shares_of_copies(sample)
    model.weights = term_log_odds(*counted_terms(sample, shares))
    model.__post_init__()

    def make():
        def work(batch):
            out = {"id": batch.column(0), "label": batch.column(1), "size": [], "segments": []}
            for t in batch.column(2).to_pylist():
                words = tokens(t)
                out["size"].append(len(words))
                out["segments"].append([s for _, _, s in model.passages(words)])
            return out

        return work

    seen = sorted(tuple(r) for r in map_batches(sample.select("id", "label", "t"), make, "id bigint, label int, size bigint, segments array<double>").collect())
    least = min(model.weights.values(), default=1.0)
    found = sum(shares[i] * len(segments) for i, label, _, segments in seen if label == 0)
    excess = sum(shares[i] * sum(max(0.0, s - least) for s in segments) for i, label, _, segments in seen if label == 0)
    n_clean = sum(shares[i] * size for i, label, size, _ in seen if label == 0)
    model.lam = (found + 1) / (excess + 1.0)
    model.k = (found + 0.5) / (n_clean + 1) * math.exp(min(50.0, model.lam * least))
    y = np.array([label for _, label, _, _ in seen], dtype=float)
    x = np.array([model.worth(segments, size) for _, _, size, segments in seen])
    model.curve = tuple(fit_logistic(x, y, prior_weights(y, counts)))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """keep (default: id_col) and score in [0, 1], one row per row of docs.

    The model is fitted on at most train_rows labelled rows of each label for
    which `usable` holds, chosen by their ids; every whole text is scored.  Null
    and empty texts get the score of a text without toxic segments.  Equal texts
    get equal scores, an empty table no rows.  No other column of docs is read,
    whatever its name.
    """
    model = fit_toxicity(*labelled_texts(docs, labels, label_col, usable, id_col, text_col, train_rows))
    return score_texts(docs, model, id_col, text_col, keep)


def drop_toxic(docs: DataFrame, labels: DataFrame, usable: Column, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that score less than limit, all columns as they are, whatever their names."""
    model = fit_toxicity(*labelled_texts(docs, labels, label_col, usable, id_col, text_col, train_rows))
    scored = _scored(docs, model, text_col, docs.columns).where(F.col("score") < limit)
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def score_texts(docs: DataFrame, model, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """keep (default: id_col) and model.scores(text) as score."""
    keep = keep or [id_col]
    return _scored(docs, model, text_col, keep).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score")


def _scored(docs: DataFrame, model, text_col: str, keep: list[str]) -> DataFrame:
    """k0, k1, .. for the columns of keep, and score."""
    columns = keep if text_col in keep else [*keep, text_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)])
    kinds = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    at = columns.index(text_col)

    def make():
        def work(batch):
            return {f"k{i}": batch.column(i) for i in range(len(keep))} | {"score": model.scores(batch.column(at).to_pylist())}

        return work

    return map_batches(rows, make, f"{kinds}, score double")
