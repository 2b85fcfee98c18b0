"""Ranked lexical search by sort-based accumulation.

A pass over the texts keeps, for each document, its number of terms and the
(term, tf) pairs of terms that some query has.  Document frequencies and lengths
are summed from these rows.  A second pass takes documents slice by slice: the
(query, document, impact) arrays of all matched terms are concatenated, their
packed keys radix sorted, and runs of equal keys summed by ``reduceat``; each
task keeps its best documents of every query in a heap.  A slice is a range of
the packed keys of each query, so only the heaps are shuffled, never impacts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_map import map_batches, map_stream
from .common import cut

#: (query, term) pairs of the queries that are answered at once; more queries take further passes, in blocks.
BLOCK_PAIRS = 500_000
#: Documents of a slice: their number within it is one digit of the radix sort.
SLICE_DOCS = 1 << 16
#: Impacts that are sorted at once, unless a single document has more.
SLICE_IMPACTS = 2_000_000
#: Weights of term frequency and length, and the scale of impacts.
LENGTH_PERCENT, SATURATION, SCALE = 75, 8, 1_000_000_000

#: What is between terms becomes a blank, A-Z lower case; bytes of other letters than ASCII stay.
TERM_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (as a-z) and anything beyond ASCII, of a text in UTF-8."""
    return (text or b"").translate(TERM_BYTES).split()


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative keys: one counting pass for each digit of 16 bits that is not in order yet."""
    order = np.arange(len(keys))
    for shift in range(0, max(1, int(keys.max(initial=0)).bit_length()), 16):
        digit = (keys[order] >> shift).astype(np.uint16)
        if len(digit) > 1 and (digit[1:] < digit[:-1]).any():
            order = order[np.argsort(digit, kind="stable")]
    return order


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their values."""
    if not len(keys):
        return keys, values
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """q_id, q_text_hash, term: binary, times: one row for each distinct term of each distinct (id, text)."""
    rows = queries.select(F.col(f"`{id_col}`").alias("q_id"), F.col(f"`{text_col}`").cast("binary").alias("q_text")).distinct()

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"q_id": [], "q_hash": [], "term": [], "times": []}
        for q, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts: dict[bytes, int] = {}
            for t in terms_of(text):
                counts[t] = counts.get(t, 0) + 1
            for t, n in counts.items():
                for name, v in zip(out, (q, h, t, n), strict=True):
                    out[name].append(v)
        return out

    kind = rows.schema["q_id"].dataType.simpleString()
    return map_batches(rows.select("q_id", F.xxhash64("q_id", "q_text").alias("q_hash"), "q_text"), lambda: work, f"q_id {kind}, q_hash bigint, term binary, times bigint")


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """d_id, n, terms, tfs: of each document the number of its terms, and the sought ones with their frequencies."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("d_id"), F.col(f"`{text_col}`").cast("binary").alias("d_text"))

    def make():
        known = vocabulary.value
        width = max(1, len(known)).bit_length()

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            sizes, places, found = [], [], []
            for k, text in enumerate(batch.column(1)):
                terms = terms_of(text.as_py())
                ids = [i for i in map(known.get, terms) if i is not None]
                sizes.append(len(terms))
                found.append(np.array(ids, np.int64))
                places.append(np.full(len(ids), k, np.int64))
            none = np.zeros(0, np.int64)
            keys, tfs = np.unique(np.concatenate([none, *places]) << width | np.concatenate([none, *found]), return_counts=True)
            offsets = np.searchsorted(keys, np.arange(batch.num_rows + 1) << width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in ((keys & ((1 << width) - 1)).astype(np.int32), tfs.astype(np.int32))]
            return {"d_id": batch.column(0), "n": sizes, "terms": lists[0], "tfs": lists[1]}

        return work

    return map_batches(rows, make, "d_id bigint, n bigint, terms array<int>, tfs array<int>")


class Accumulator:
    """Scores documents for all queries of a block, and keeps the best of each query.

    starts, queries, times: for term t the queries that have it, and how often, are
    those from starts[t] to starts[t + 1].
    """

    def __init__(self, starts: np.ndarray, queries: np.ndarray, times: np.ndarray, weights: np.ndarray, n_queries: int, documents: int, total: int, top: int):
        self.starts, self.queries, self.times, self.weights = starts, queries, times, weights
        self.documents, self.total, self.top = documents, total, top
        self.heaps: list[list[tuple[int, bool, int]]] = [[] for _ in range(n_queries)]
        #: What a document has to score at least to be among the best so far.
        self.least = np.ones(n_queries, np.int64)

    def add(self, ids: list[int | None], n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Documents with their lengths and postings, in slices of at most SLICE_DOCS of them and about SLICE_IMPACTS impacts."""
        reach = np.concatenate([[0], np.cumsum((self.starts[1:] - self.starts[:-1])[terms])])[offsets]
        a = 0
        while a < len(ids):
            b = int(np.searchsorted(reach, reach[a] + SLICE_IMPACTS, side="right")) - 1
            b = min(max(b, a + 1), a + SLICE_DOCS, len(ids))
            lo, hi = offsets[a], offsets[b]
            place = np.repeat(np.arange(b - a), offsets[a + 1 : b + 1] - offsets[a:b])
            self._slice(ids[a:b], n[a:b], place, terms[lo:hi], tfs[lo:hi])
            a = b

    def _slice(self, ids: list[int | None], n: np.ndarray, place: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * self.documents) // max(1, self.total)
        impact = self.weights[terms] * ((SCALE * tfs) // (1000 * tfs + SATURATION * m[place]))
        first, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)
        keys, scores = summed(self.queries[at] << 16 | np.repeat(place, size), np.repeat(impact, size) * self.times[at])
        query = keys >> 16
        hopeful = np.flatnonzero(scores >= self.least[query])
        query, scores, place = query[hopeful], scores[hopeful], (keys & (SLICE_DOCS - 1))[hopeful]
        edges = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1], [True]])) if len(query) else np.zeros(0, int)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            q, s = int(query[lo]), scores[lo:hi]
            if hi - lo > self.top:  # ties at the border stay for the heap
                pick = np.flatnonzero(s >= np.partition(s, len(s) - self.top)[len(s) - self.top])
            else:
                pick = range(hi - lo)
            heap = self.heaps[q]
            for i in pick:
                doc = ids[int(place[lo + i])]
                entry = (int(s[i]), doc is not None, -(doc or 0))
                if len(heap) < self.top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[q] = max(1, heap[0][0])

    def best(self) -> Iterator[tuple[int, int | None, int]]:
        for q, heap in enumerate(self.heaps):
            for score, known, doc in heap:
                yield q, -doc if known else None, score


def _ranked_block(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, top: int) -> DataFrame:
    """The best documents of the queries of one block; pairs are at most some BLOCK_PAIRS rows of query_terms, but for one longer query."""
    spark = docs.sparkSession
    rows = pairs.toArrow()
    terms, codes = np.unique(np.array(rows["term"].to_pylist(), object), return_inverse=True) if rows.num_rows else (np.zeros(0, object), np.zeros(0, int))
    hashes, query = np.unique(np.array(rows["q_hash"].to_pylist(), np.int64), return_inverse=True)
    names = dict(zip(rows["q_hash"].to_pylist(), rows["q_id"].to_pylist(), strict=True))
    order = np.lexsort([query, codes])
    index = np.searchsorted(codes[order], np.arange(len(terms) + 1)), query[order].astype(np.int64), np.array(rows["times"].to_pylist(), np.int64)[order]
    context = spark.sparkContext
    found = cut(postings(docs, id_col, text_col, context.broadcast({t: i for i, t in enumerate(terms)})))
    documents, total = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for t, k in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
        df[t] = k
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    shared = context.broadcast((*index, weights, len(hashes), documents, total, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Accumulator(*shared.value)
        for batch in batches:
            n, lists, tfs = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            work.add(batch.column(0).to_pylist(), n, offsets, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        best = list(work.best())
        for at in range(0, len(best), 50_000):
            q, d, s = zip(*best[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["q", "doc_id", "score"])

    heaps = map_stream(found, run, "q bigint, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = heaps.select("*", rank.alias("rank")).where(F.col("rank") <= top)
    kind = pairs.schema["q_id"].dataType.simpleString()
    known = spark.createDataFrame([(i, names[h]) for i, h in enumerate(hashes.tolist())], f"k bigint, q_id {kind}")
    return best.join(known, F.col("q") == F.col("k")).select("q_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", top: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score: of every query the `top` documents with the highest scores above 0.

    Scores are exact integers; equal ones rank by ascending id.  Null texts have
    no terms; queries without terms, and terms that no document has, give no rows;
    an empty table gives none.  Rows of docs that repeat an id, or have none, are
    ranked each for itself, those without an id last among equal scores.  Rows of
    queries that repeat an id and a text are one query; one id with several texts
    is several, a null id an id like others.  Other columns are ignored, whatever
    their names.  Memory of a task is bounded by a batch of texts (or one longer
    text), SLICE_IMPACTS and the index of a block of queries (BLOCK_PAIRS); beyond
    that number queries are answered in blocks, each by a pass over all documents.
    """
    pairs = cut(query_terms(queries, query_id, query_text))
    blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    out = None
    for k in range(blocks):
        part = pairs.where(F.pmod("q_hash", F.lit(blocks)) == k) if blocks > 1 else pairs
        ranked = _ranked_block(docs, part, id_col, text_col, top)
        out = ranked if out is None else out.unionByName(ranked)
    assert out is not None
    return out.withColumnRenamed("q_id", query_id)
