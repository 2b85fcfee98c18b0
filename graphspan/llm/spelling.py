"""Grouping of spelling variants with forward and reversed sorted dictionaries.

Two words that differ by one edit agree before and after one place.  If that
place is in the second half they share their first half, and stand in one block of
the dictionary sorted forwards; otherwise they share their second half, and stand
in one block of the dictionary sorted by reversed words.  A block is a range of
places `lo`..`hi`: its words agree before lo and after hi.  Blocks with many
words are subdivided, by halves of their range again, down to single places if need be;
a block then has as many words as letters at most.  Ranges of places do not
overlap and a pair has one place (the end of its common prefix), so every pair
is met in one block, once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_map import map_stream
from .common import cut

#: Words of a block that are compared with one another; larger blocks are subdivided unless they have one place.
BLOCK = 48
#: Distinct words that a task counts before it lets go of their counts.
HELD = 100_000
#: One of so many (document, word) is misspelt on purpose.
MISSPELT = 199
FORM_FACTOR = 5

#: Latin-1 bytes: letters stay, A-Z in lower case, all else is a blank.
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0xC0 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
KEY = ["kind", "m", "lo", "hi", "left", "right"]


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters A-Z (as a-z), a-z and U+00C0 to U+00FF, as Latin-1 bytes."""
    return (text or "").encode("latin-1", "replace").translate(LETTERS).split()


def misspelt(prefix: int, run: bytes) -> bytes:
    """The run without one letter if its checksum, on from that of the document's id, is a multiple of MISSPELT."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode("utf-8"), prefix)
    if h % MISSPELT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_length: int) -> DataFrame:
    """word, n over all documents; counts are combined in a task before they are shuffled."""
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("t"))

    def flushed(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                prefix = zlib.crc32(f"{doc.as_py()}:".encode())
                for run, k in Counter(runs_of(text.as_py())).items():
                    if len(run) >= least_length:
                        word = misspelt(prefix, run)
                        if len(word) >= least_length:
                            held[word] = held.get(word, 0) + k
                if len(held) >= HELD:
                    yield flushed(held)
                    held = {}
        if held:
            yield flushed(held)

    return map_stream(rows, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _placed(rows: DataFrame, ranges) -> DataFrame:
    """rows(kind, m, role, word, n), once in each of the ranges (lo, hi), with what stands before and after these places."""
    rows = rows.select("kind", "m", "role", "word", "n", F.explode(ranges).alias("r")).select("kind", "m", "role", "word", "n", "r.lo", "r.hi")
    after = F.col("m") - F.col("hi") - (F.col("kind") == 0).cast("int")
    left, right = F.substring("word", F.lit(1), F.col("lo")), F.when(after > 0, F.right("word", after)).otherwise("")
    return rows.select("kind", "m", "lo", "hi", left.alias("left"), right.alias("right"), "role", "word", "n")


def _range(lo, hi):
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def members(words: DataFrame, least_length: int) -> DataFrame:
    """Each word in its blocks of the forward and of the reversed dictionary.

    kind 0: words of m letters that differ in one; kind 1: words of m letters
    (role 0) and of one more (role 1).
    """
    size = F.char_length("word")
    roles = F.array(*[F.struct(F.lit(k).alias("kind"), (size - F.lit(r)).alias("m"), F.lit(r).alias("role")) for k, r in ((0, 0), (1, 0), (1, 1))])
    rows = words.select("word", "n", F.explode(roles).alias("r")).select("r.*", "word", "n").where(F.col("m") >= least_length)
    half, last = F.floor((F.col("m") + F.col("kind")) / 2), F.col("m") - 1 + F.col("kind")
    return _placed(rows, F.array(_range(half, last), _range(F.lit(0), half - 1)))


def blocks(words: DataFrame, least_length: int) -> DataFrame:
    """The members of all blocks that can have pairs, subdivided to at most BLOCK words or a single place."""
    rows, done = members(words, least_length), None
    while True:
        rows = cut(rows)
        sizes = rows.groupBy(*KEY).agg(F.count("*").alias("size"), F.max("role").alias("most"), F.min("role").alias("fewest"))
        sizes = cut(sizes.where("size > 1 AND (kind = 0 OR most > fewest)").select(*[F.col(c).alias(f"b_{c}") for c in KEY], "size"))
        joined = rows.join(sizes, [F.col(c) == F.col(f"b_{c}") for c in KEY]).select(*rows.columns, "size")
        fits = (F.col("size") <= BLOCK) | (F.col("lo") == F.col("hi"))
        ready = cut(joined.where(fits).drop("size"))
        done = ready if done is None else done.union(ready)
        large = sizes.where((F.col("size") > BLOCK) & (F.col("b_lo") < F.col("b_hi")))
        if large.isEmpty():
            return done
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        rows = _placed(joined.where(~fits), F.array(_range(F.col("lo"), middle), _range(middle + 1, F.col("hi"))))


def _letters(words: list[str], width: int) -> np.ndarray:
    """A row of code points for each word of `width` letters or fewer, 0 beyond its end."""
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)


def replaced(a: np.ndarray, b: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Whether rows differ in one of the places lo..hi."""
    return (a[:, lo : hi + 1] != b[:, lo : hi + 1]).sum(1) == 1


def inserted(a: np.ndarray, b: np.ndarray, m: int, lo: int, hi: int) -> np.ndarray:
    """Whether b is a (of m letters) with one letter more, and their common prefix ends in lo..hi."""
    same = a[:, lo : min(hi + 1, m)] == b[:, lo : min(hi + 1, m)]
    prefix = np.logical_and.accumulate(same, 1).sum(1)
    shifted = a[:, lo:hi] == b[:, lo + 1 : hi + 1]
    agree = np.ones((len(a), hi - lo + 1), bool)  # agree[:, k]: all from lo + k on agree with the next letter of b
    agree[:, :-1] = np.logical_and.accumulate(shifted[:, ::-1], 1)[:, ::-1]
    return (prefix <= hi - lo) & agree[np.arange(len(a)), np.minimum(prefix, hi - lo)]


def _pairs(kind: int, m: int, lo: int, hi: int, block: np.ndarray, role: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of near pairs within blocks of one range; rows are in order of block, role, word."""
    rows, firsts, seconds = _letters(words, m + kind), [], []
    at = np.arange(len(words))
    for step in range(1, len(words)):
        at = at[: np.searchsorted(at, len(words) - step)]
        at = at[block[at] == block[at + step]]
        if not len(at):
            break
        pick = at if kind == 0 else at[role[at] < role[at + step]]
        a, b = rows[pick], rows[pick + step]
        pick = pick[replaced(a, b, lo, hi) if kind == 0 else inserted(a, b, m, lo, hi)]
        firsts.append(pick)
        seconds.append(pick + step)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *firsts]), np.concatenate([none, *seconds])


def near_pairs(members: DataFrame) -> DataFrame:
    """word_a, n_a, word_b, n_b of all pairs one edit apart, each once: sorted ranges of the dictionaries are scanned."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY, "role", "word")
    rows = rows.select(*KEY, "role", "word", "n")

    def scan(table: pa.Table) -> pa.RecordBatch:
        change = np.zeros(table.num_rows, bool)
        spans = np.zeros(table.num_rows, bool)
        for c in KEY:
            new = pc.not_equal(table[c][1:], table[c][:-1]).to_numpy()
            change[1:] |= new
            spans[1:] |= new if c not in ("left", "right") else False
        block, words, role = np.cumsum(change), table["word"].to_pylist(), table["role"].to_numpy()
        edges = [0, *np.flatnonzero(spans).tolist(), table.num_rows]
        n, out = table["n"].to_numpy(), [[], []]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            kind, m, lo, hi = (table[c][a].as_py() for c in KEY[:4])
            x, y = _pairs(kind, m, lo, hi, block[a:b], role[a:b], words[a:b])
            out[0].append(x + a)
            out[1].append(y + a)
        x, y = np.concatenate(out[0]), np.concatenate(out[1])
        arrays = [table["word"].take(pa.array(x)), pa.array(n[x]), table["word"].take(pa.array(y)), pa.array(n[y])]
        return pa.Table.from_arrays(arrays, ["word_a", "n_a", "word_b", "n_b"]).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            last = table.slice(table.num_rows - 1)
            at = pc.and_(pc.equal(table["left"], last["left"][0]), pc.equal(table["right"], last["right"][0]))
            for c in KEY[:4]:
                at = pc.and_(at, pc.equal(table[c], last[c][0]))
            first = pc.index(at, True).as_py()  # where the last block begins: more of it may follow
            if first:
                yield from scan(table.slice(0, first).combine_chunks()).to_batches()
            held = table.slice(first)
        if held is not None:
            yield from scan(held.combine_chunks()).to_batches()

    return map_stream(rows, run, "word_a string, n_a bigint, word_b string, n_b bigint")


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): forms followed to the last, by doubling of steps.  n grows fivefold a step, so there are few."""
    steps = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("w"), F.col("root").alias("r"))
        onward = cut(steps.join(further, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        if onward.where("moved").isEmpty():
            return steps
        steps = onward.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least least_length letters and least_n occurrences.

    n_near: words one edit away.  form: of these the most frequent one, the first in
    code-point order of equals, if it occurs FORM_FACTOR times as often as the word;
    else null.  root: forms followed to the last, the word itself without a form.

    Null and empty texts have no words; an empty table gives no rows.  Null ids count as
    empty ones in the checksums that misspell words; rows that repeat an id or a text count each.
    Other columns are ignored, whatever their names.  Memory is bounded by
    a batch of texts (or one longer text), HELD words, and a batch of sorted words.
    """
    words = cut(word_counts(docs, id_col, text_col, least_length).where(F.col("n") >= least_n))
    pairs = cut(near_pairs(blocks(words, least_length)))
    both = pairs.toDF("word", "n", "near", "near_n").union(pairs.select("word_b", "n_b", "word_a", "n_a"))
    better = F.when(F.col("near_n") >= FORM_FACTOR * F.col("n"), F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    near = cut(both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(better).alias("best")).select(F.col("word").alias("w"), "n_near", "best"))
    roots = last_forms(near.where("best IS NOT NULL").select(F.col("w").alias("word"), F.col("best.form").alias("form"))).select(F.col("word").alias("v"), "root")
    out = words.join(near, F.col("word") == F.col("w"), "left").join(roots, F.col("word") == F.col("v"), "left")
    return out.select("word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), (-F.col("best.minus")).alias("form_n"))
