"""Token counts with a whole-token shortcut.

No vocabulary string holds a space mark after another letter, so merges stay
inside a run of space marks with the letters that follow it: a pre-token.  Which
vocabulary strings come out of merging as one token is proved beforehand, string
by string; pre-tokens that equal one of these count 1 without any merging, and
only the rest is merged.
"""

from __future__ import annotations

import heapq
import re

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_map import map_batches

#: Bytes of merged pre-tokens with their counts that a worker keeps, and what an entry takes besides its letters.
CACHE_BYTES = 32_000_000
ENTRY_BYTES = 160
#: Up to so many symbols the best pair is sought by looking at all.
SHORT = 24
#: Bytes of text that are counted at once, unless a single text has more.
SLICE_BYTES = 1_000_000
#: The letter that stands for a space.
MARK = "▁"
PRE_TOKENS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Merged(dict):
    """Counts of pre-tokens: those of whole tokens for good, the others while they are in use."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.older, self.bytes = pieces, {}, 0
        for w in pieces.alone:
            self[w] = 1

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.pieces.count(word)
        if len(word) <= 64:
            if self.bytes >= CACHE_BYTES // 2:
                self.older = {w: k for w, k in self.items() if w not in self.pieces.alone}
                self.clear()
                self.update(dict.fromkeys(self.pieces.alone, 1))
                self.bytes = 0
            self.bytes += ENTRY_BYTES + len(word)
            self[word] = n
        return n


class Pieces:
    """The vocabulary of a sentencepiece file of BPE pieces with byte fallback and no normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        kinds = model.SentencePiece
        normal, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("pieces of BPE with byte fallback and no normalisation are expected")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = MARK if normal.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece goes across words")
        #: Letters of some longer piece: all others stand alone, so that merges do not go across them.
        self.joined = {c for p in self.score if len(p) > 1 for c in p}
        self.alone = frozenset(p for p in self.score if self.count(p) == 1)
        self.counts = Merged(self)

    def _lone(self, letter: str) -> int:
        """Tokens of a symbol that is left over: one, or its bytes if it is in no vocabulary."""
        return 1 if letter in self.score else len(letter.encode("utf-8"))

    def count(self, word: str) -> int:
        """Tokens of a pre-token, by merging the pair that makes the best piece, the first of equals."""
        if self.joined.issuperset(word):
            return self._merge(list(word))
        total, part = 0, []
        for c in word:
            if c in self.joined:
                part.append(c)
                continue
            total += self._lone(c) + self._merge(part)
            part = []
        return total + self._merge(part)

    def _merge(self, symbols: list[str]) -> int:
        if len(symbols) > SHORT:
            symbols = self._merge_long(symbols)
        score = self.score.get
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return sum(map(self._lone, symbols))

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same by a heap over a linked list, in n log n."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(symbols)
            if j < len(symbols) and (s := self.score.get(piece := symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-s, i, j, piece))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if not symbols[i] or after[i] != j or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, ""
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [s for s in symbols if s]

    def tokens(self, text: str | None) -> int:
        """Tokens of a whole text.  Nothing is merged across spaces: texts without runs of them are cut at each."""
        if not text:
            return 0
        known = self.counts
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " " or not self.prefix:
            words = PRE_TOKENS.findall(self.prefix + text.replace(" ", MARK))
        else:
            words = (MARK + text.replace(" ", f" {MARK}")).split(" ")
        return sum(map(known.__getitem__, words))


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The pieces of a file, read and proved once per worker process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens): a row for each row of docs.

    path: a vocabulary file that every worker can open.  Null texts count as
    empty and have no tokens.  Rows that repeat an id or a text are counted alike,
    each for itself; a null id stays null; an empty table gives no rows; other columns are ignored,
    whatever their names.  Special strings inside texts are ordinary text.  Memory
    is bounded by SLICE_BYTES of text (or one longer text) and CACHE_BYTES.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"))

    def make():
        pieces = pieces_of(path)

        def work(batch):
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast("int64")
            return {"k": batch.column(0), "n_bytes": sizes, "n_tokens": [pieces.tokens(t.as_py()) for t in texts]}

        return work

    out = map_batches(rows, make, f"k {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint", SLICE_BYTES)
    return out.select(F.col("k").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
