"""Byte-pair encoding and decoding by dynamic programming over prefixes.

The encoding of every prefix of a word ends in exactly one token.  For each end
position an automaton gives the tokens that end there; the last token of that
prefix is the one that is compatible with the last token of what stands before
it, i.e. whose pair would not be merged across its border.  Following the last
tokens back from the end of the word gives exactly the ids that merging by rank
gives, in linear time and without a priority queue.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_map import map_batches

#: Bytes of words and their encodings that a worker keeps, and what an entry takes besides its own bytes.
CACHE_BYTES = 32_000_000
ENTRY_BYTES = 240
#: Pairs of tokens whose compatibility a worker keeps.
CACHE_PAIRS = 200_000
#: Bytes of text that are encoded at once, unless a single text has more.
SLICE_BYTES = 1_000_000
# Fixed values.  White space as the vocabulary file's library has it; code points
# that are letters or numbers in the regex module's Unicode but not in that
# library's; letters (first, last, first lower-case one) that its Unicode has
# lower-case forms of and Python's has not.
SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATER = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LOWER = [
    (0x03A3, 0x03A3, 0x03C3), (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
LOWERED = {a + i: to + i for a, b, to in LOWER for i in range(b - a + 1)}
SEPARATORS = re.compile(r"[\x1c-\x1f]")
NEVER = 1 << 60
MARKS = frozenset(".,;:!?")
#: Below, letters are the same in all versions of Unicode.
LATIN = "\u0250"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if
    printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(others)) for b in range(256)]


LOWERED_SOME = re.compile("[" + "".join(map(chr, LOWERED)) + "]")


def lower_case(text: str) -> str:
    """Normal form C, then each letter by itself in lower case (a final sigma is no exception)."""
    text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return (text.translate(LOWERED) if LOWERED_SOME.search(text) else text).lower()


class WordBpe:
    """The encoder of a vocabulary file with word ends (JSON of the tokenizers library).

    Last letters of words are other letters than the same ones within a word:
    they are moved up by LIFT code points here, so that a token is a string
    of letters and a word end needs no special case.
    """

    LIFT = 0x80000

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        own = lambda t: t[: -len(suffix) - 1] + chr(ord(t[-len(suffix) - 1]) + self.LIFT) if t.endswith(suffix) and t != suffix else t
        self.names = {i: t for t, i in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in special.items()}
        self.special = special
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        ids = {own(t): i for t, i in model["vocab"].items()}
        self.text = {i: t for t, i in ids.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair = ids[own(a)], ids[own(b)]
            self.rank[pair] = r
            self.made.setdefault(ids[own(a + b)], (r, *pair))
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, tuple] = {}
        self.single: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            if len(t) == 1 or self._whole(i):
                self.automaton.add_word(t, (i, len(t)))
                self.single[t] = i
        self.automaton.make_automaton()
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", SPACE))
        known = pattern.replace(r"\s", SPACE).replace(r"\p{L}", rf"[\p{{L}}--[{LATER}]]").replace(r"\p{N}", rf"[\p{{N}}--[{LATER}]]")
        self.known_words = regex.compile(known, regex.V1)
        self.later = re.compile(f"[{LATER}]")
        # pieces that are one word, or a word and one mark, need no pattern if the pattern says so of all of them
        self.plain = self.words.findall("word") == ["word"] and all(self.words.findall("word" + m) == ["word", m] for m in MARKS)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept_bytes = 0

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of what comes next) from the outermost letter (side 2: the last, 1: the first) up to the token."""
        if (token, side) not in self.spines:
            at, upward, after = token, [], NEVER
            while True:
                upward.append((at, after))
                if at not in self.made:
                    break
                after = self.made[at][0]
                at = self.made[at][side]
            self.spines[token, side] = upward[::-1]
        return self.spines[token, side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the letters of both, side by side, still end as these two tokens.

        The border lies between the last part of the left token and the first
        part of the right one.  Both grow by merges of rising rank; the border
        falls if, in some state, its pair's rank comes before the next merge of
        either side (at equal ranks the leftmost pair goes first).
        """
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            a, b, i, j = self.spine(left, 2), self.spine(right, 1), 0, 0
            known = True
            while True:
                (x, grow_x), (y, grow_y) = a[i], b[j]
                r = self.rank.get((x, y), NEVER)
                if r < NEVER and r < grow_x and r <= grow_y:
                    known = False
                    break
                if grow_x == grow_y == NEVER:
                    break
                if grow_x <= grow_y:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _whole(self, token: int) -> bool:
        """Whether merging the token's letters gives the token: its two halves are whole and merge first."""
        if token not in self.made:
            return len(self.text[token]) == 1
        r, a, b = self.made[token]
        if not (self._whole_of(a) and self._whole_of(b)):
            return False
        left, right, i, j = self.spine(a, 2), self.spine(b, 1), 0, 0
        while True:
            (x, grow_x), (y, grow_y) = left[i], right[j]
            q = self.rank.get((x, y), NEVER)
            if grow_x == grow_y == NEVER:
                return q == r
            if q < NEVER and q < grow_x and q <= grow_y:
                return False
            if grow_x <= grow_y:
                i += 1
            else:
                j += 1

    @lru_cache(maxsize=None)  # noqa: B019
    def _whole_of(self, token: int) -> bool:
        return self._whole(token)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, by the last token of each prefix."""
        if word.isascii() and word.isprintable():  # such bytes stand for themselves
            s = word
        else:
            letters = self.letters
            s = "".join([letters[b] for b in word.encode("utf-8")])
        s = s[:-1] + chr(ord(s[-1]) + self.LIFT)
        if (token := self.single.get(s)) is not None:
            return [token]
        last: list[int] = [-1] * (len(s) + 1)
        size: list[int] = [0] * (len(s) + 1)
        known = self.pairs.get
        for end, (token, n) in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            if n < end:
                before = last[end - n]
                if before < 0:
                    continue
                fits = known(before << 20 | token)
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last[end], size[end] = token, n
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def pre_tokens(self, text: str) -> list[str]:
        """Words of a text in normal form C and lower case."""
        words = self.known_words if not text.isascii() and self.later.search(text) else self.words
        return words.findall(text)

    def _word(self, word: str) -> bytes:
        """Ids of a word that is not among the kept ones; the older half is let go of when the newer one is full."""
        packed = self.older.get(word)
        if packed is None:
            ids = self.encode_word(word)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if self.kept_bytes >= CACHE_BYTES // 2:
                self.older, self.kept, self.kept_bytes = self.kept, {}, 0
            self.kept_bytes += ENTRY_BYTES + len(word) + len(packed)
            self.kept[word] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        No word goes across white space, so what stands between is encoded piece
        by piece; words that were met before are looked up.
        """
        out: list[bytes] = []
        text = text or ""
        add, word = out.append, self._word
        for part in self.special_pattern.split(text) if self.special_pattern and "<|" in text else [text]:
            if part in self.special:
                add(struct.pack("<I", self.special[part]))
            elif part:
                lower = part.lower() if part.isascii() else lower_case(part)
                # str.split also cuts at these four, which are no white space here
                pieces = re.split(f"[{SPACE}]+", lower) if SEPARATORS.search(lower) else lower.split()
                for piece in pieces:
                    if (ids := self.kept.get(piece)) is not None:
                        add(ids)
                    elif self.plain and max(piece, default="") < LATIN:
                        if piece.isalpha():
                            add(word(piece))
                        elif piece[-1:] in MARKS and (head := piece[:-1]).isalpha():
                            add(self.kept.get(head) or word(head))
                            add(self.kept.get(piece[-1]) or word(piece[-1]))
                        else:
                            out += [self.kept.get(w) or word(w) for w in self.words.findall(piece)]
                    else:
                        out += [self.kept.get(w) or word(w) for w in self.pre_tokens(piece)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Names of the tokens, with spaces between them, as a vocabulary file without a decoder has it."""
        return " ".join(map(self.names.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


_loaded: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """The encoder of a file, made once per worker process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


#: What can be asked for: column -> its type and how it comes from the packed ids.
OUTPUTS = {
    "n_tokens": ("bigint", lambda bpe, ids: len(ids) // 4),
    "ids": ("binary", lambda bpe, ids: ids),
    "decoded": ("string", lambda bpe, ids: bpe.decode(ids)),
    "ids_sha256": ("string", lambda bpe, ids: hashlib.sha256(ids).hexdigest()),
    "decoded_sha256": ("string", lambda bpe, ids: hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest()),
}


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """keep (default: id_col) and outputs, one row per row of docs.

    outputs: some of n_tokens, ids (packed little-endian unsigned 32-bit), decoded
    and the SHA-256 of either, which a worker makes text by text without keeping
    the ids or the decoded text.  path: a vocabulary file that every worker can
    open.  Null texts count as empty: no tokens, an empty decoded text.  Special
    tokens' strings in a text become their ids.  Repeated rows are encoded alike;
    an empty table gives no rows; other columns are ignored, whatever their names.
    Memory is bounded by SLICE_BYTES of text or one longer text, and CACHE_BYTES.
    """
    keep = keep or [id_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("bpe_text"))
    kinds = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"o_{c} {OUTPUTS[c][0]}" for c in outputs]

    def make():
        bpe = encoder(path)
        makers = [(f"o_{c}", OUTPUTS[c][1]) for c in outputs]

        def work(batch):
            out = {name: [] for name, _ in makers}
            for text in batch.column(len(keep)):
                ids = bpe.encode(text.as_py())
                for name, maker in makers:
                    out[name].append(maker(bpe, ids))
            return {f"k{i}": batch.column(i) for i in range(len(keep))} | out

        return work

    out = map_batches(rows, make, ", ".join(kinds), SLICE_BYTES)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"o_{c}").alias(c) for c in outputs])
