"""Ranked search, token counts and spelling variants against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from graphspan.llm import ranked_search, spelling, token_counts

DOC = "doc_id long, text string, lang string, term string, n long, score long, word string, q long, k long"
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 1, 1, "clash", 1, 1) for i, t in rows], DOC)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 5, "clash") for i, t in rows], "item_id long, text string, rank int, term string")


# ranked search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, top=10):
    docs = [(i, Counter(t for t in TERMS.findall((x or "").translate(LOWER)))) for i, x in docs]
    n_docs, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for doc, c in docs:
            if c:
                m = 25 + (75 * sum(c.values()) * n_docs) // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in TERMS.findall((text or "").translate(LOWER)) if c[t])
                if score > 0:
                    found.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def search_case(seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "ÀB", "x1", "日本", "a b", "q-r", "under_score", *("w%d" % i for i in range(60))]
    prose = lambda n: " ".join(rng.choice(words[:12]) if rng.random() < 0.5 else rng.choice(words) for _ in range(n))
    docs = [(i * 3, prose(rng.randint(0, 80))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [docs[9]] * 4 + [(None, docs[9][1]), (None, docs[9][1]), (5, None), (6, ""), (8, " .,;"), (9, "the " * 3000)]
    items = [(i, prose(rng.randint(1, 30))) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, docs[7][1]), (94, docs[9][1]), (94, docs[9][1]), (94, "the"), (None, "w1 w1 w2")]
    return docs, items


def got_search(spark, docs, items, **how):
    rows = ranked_search.ranked_search(docs_of(spark, docs), items_of(spark, items), **how)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in rows.collect()], key=str)


def test_ranked_search(spark):
    docs, items = search_case()
    assert got_search(spark, docs, items) == brute_search(docs, items)
    assert got_search(spark, docs, items, top=3) == brute_search(docs, items, 3)


def test_ranked_search_in_blocks_and_slices(spark, monkeypatch):
    """Several blocks of queries; slices of a few impacts are tested on the accumulator, as workers have their own module."""
    docs, items = search_case(2)
    monkeypatch.setattr(ranked_search, "BLOCK_PAIRS", 60)
    assert got_search(spark, docs, items) == brute_search(docs, items)
    rng = np.random.default_rng(3)
    n_docs, n_terms = 500, 40
    held = [np.unique(rng.integers(0, n_terms, 12)) for _ in range(n_docs)]
    offsets = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    terms, tfs = np.concatenate(held), rng.integers(1, 4, offsets[-1])
    starts = np.arange(n_terms + 1) * 3
    sought = np.concatenate([np.sort(rng.choice(20, 3, replace=False)) for _ in range(n_terms)])
    make = lambda: ranked_search.Accumulator(starts, sought, np.ones(len(sought), np.int64), np.arange(n_terms) + 1, 20, n_docs, 6000, 10)
    n = np.full(n_docs, 12)
    whole, sliced = make(), make()
    whole.add(list(range(n_docs)), n, offsets, terms, tfs)
    monkeypatch.setattr(ranked_search, "SLICE_IMPACTS", 50)
    sliced.add(list(range(n_docs)), n, offsets, terms, tfs)
    assert sorted(whole.best()) == sorted(sliced.best()) and len(list(whole.best())) == 200


def test_ranked_search_of_nothing(spark):
    assert got_search(spark, [], [(1, "the")]) == [] and got_search(spark, [(1, "the")], []) == []
    assert got_search(spark, [(1, None), (2, ".")], [(1, "the")]) == []
    assert got_search(spark, [(4, "the"), (2, "THE")], [(1, "the the")]) == brute_search([(4, "the"), (2, "THE")], [(1, "the the")])


def test_radix_order():
    rng = np.random.default_rng(1)
    for most in (1, 9, 1 << 16, 1 << 40, 1 << 62):
        keys = rng.integers(0, most, 5000)
        assert (ranked_search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
        distinct, sums = ranked_search.summed(keys, np.arange(5000))
        assert (distinct == np.unique(keys)).all() and sums.sum() == np.arange(5000).sum()


# token counts

ODD = ["", " ", "  ", "   a", "a   ", "a  b", "\n", " \n ", "▁", "▁▁a▁", "<s>hi</s>", "<unk>", "<0x41>", "\x00\x01", "é́", "日本語テキスト", "\U0001f600\U0001f468‍\U0001f469", "﻿x", "a b　c", "x" * 300, "ab" * 400, " " * 100, "the" * 50 + " " * 17 + "the", "ÀÉ ñandú", "\t\ttabs\tand\n\nlines  "]


def test_token_counts_are_those_of_the_library(spark):
    rng = random.Random(2)
    alphabet = list("abcdefghij .,\n▁é日<>/s0x") + ["  ", "the", "tion", "\U0001f600"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(1500)]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = token_counts.pieces_of(PIECES)
    for text, ids in zip(texts, library.encode(texts), strict=True):
        assert pieces.tokens(text) == len(ids), text
    rows = [(i, t) for i, t in enumerate(texts[:60])] + [(None, "a b"), (7, None), (7, texts[7]), (7, texts[7])]
    out = token_counts.count_tokens(docs_of(spark, rows), PIECES, 20).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 20) for i, t in rows]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(docs_of(spark, []), PIECES, 20).count() == 0


def test_proof_of_whole_tokens():
    """Exactly the pieces that come out of the library's merging as themselves count without merging."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = token_counts.pieces_of(PIECES)
    words = [p for p in pieces.score if p.startswith("▁") and p.strip("▁")]
    alone = {p for p, ids in zip(words, library.encode([p[1:] for p in words]), strict=True) if len(ids) == 1}
    assert {p for p in words if p in pieces.alone} == alone and len(alone) > 10_000


def test_long_pre_tokens_and_a_small_cache(monkeypatch):
    rng = random.Random(5)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = token_counts.pieces_of(PIECES)
    for text in ("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(200_000)), "a" * 100_000, " ".join("".join(rng.choice("aeinrst") for _ in range(9)) for _ in range(150_000))):
        assert pieces.tokens(text) == len(library.encode(text))
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 4000)
    small = token_counts.Pieces(PIECES)
    text = " ".join("".join(rng.choice("aeinrstz") for _ in range(rng.randint(2, 9))) for _ in range(5000))
    assert small.tokens(text) == len(library.encode(text)) and len(small.counts) < len(small.alone) + 100


# spelling variants

RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    counts = Counter()
    for doc, text in docs:
        for run in RUNS.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    out, form = {}, {}
    for w, n in words.items():
        others = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by[size] if v != w and near(w, v)]
        best = min(((-words[v], v) for v in others if words[v] >= 5 * n), default=None)
        form[w] = best[1] if best else None
        out[w] = (n, len(others), -best[0] if best else None)
    rows = []
    for w, (n, k, form_n) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, k, form_n))
    return sorted(rows, key=str)


def variant_docs(seed=4):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéÿÀ×") for _ in range(rng.randint(6, 12))) for _ in range(40)]
    words = Counter()
    for s in stems:
        words[s] += rng.choice([5, 25, 150])
        for _ in range(12):
            i = rng.randrange(len(s) + 1)
            v = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abz") + s[i:], s[:i] + rng.choice("abz") + s[i + 1 :]])
            words[v] += rng.choice([1, 5, 6, 30])
    hot = "sharedprefix"
    words.update({hot + a + b: rng.choice([5, 5, 30]) for a in "abcdefghijklmn" for b in "opqrstuvwxyz"})  # a block of very many words
    words.update({a + b + "suffixshared": 5 for a in "abcdefgh" for b in "opqrstuv"})
    words.update({"aaaaaaa" + "b" * k: 5 + k for k in range(9)} | {"a" * k: 125 for k in range(5, 12)} | {"chain" + "z" * k: n for k, n in enumerate((6, 40, 240, 1400), 1)})
    flat = [w if rng.random() < 0.7 else w.capitalize() for w, n in words.items() for _ in range(n)]
    rng.shuffle(flat)
    seps = [" ", ", ", "\n", "1", "_", " 日 ", "Ā"]
    return [(i, "".join(w + rng.choice(seps) for w in flat[k : k + 100])) for i, k in enumerate(range(0, len(flat), 100))]


@pytest.mark.parametrize("block", [48, 3])
def test_spelling_variants(spark, monkeypatch, block):
    """With a low limit, blocks are subdivided down to single places."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    docs = [*variant_docs(), (None, "nullid " * 9), (None, None), (3, ""), (3, "x" * 5), *[(77, "repeated rows repeated " * 3)] * 4, (78, "q" * 3000 + (" " + "r" * 2999 + "s") * 6 + (" " + "r" * 3000) * 6)]
    got = sorted([tuple(r) for r in spelling.spelling_variants(docs_of(spark, docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()], key=str)
    want = brute_variants(docs)
    assert got == want
    assert sum(r[1] is not None for r in want) > 100 and {r[2] for r in want if r[0].startswith("chain")} == {"chainzzzz"}


def test_spelling_variants_of_nothing(spark):
    assert spelling.spelling_variants(docs_of(spark, [])).count() == 0
    assert spelling.spelling_variants(docs_of(spark, [(1, None), (2, "short words only")])).count() == 0
    assert [tuple(r) for r in spelling.spelling_variants(docs_of(spark, [(1, "single " * 5)])).collect()] in ([("single", None, "single", 5, 0, None)], [])


def test_edit_in_a_range():
    rng = random.Random(8)
    for _ in range(2000):
        m = rng.randint(1, 8)
        a = "".join(rng.choice("ab") for _ in range(m))
        i = rng.randrange(m + 1)
        b = a[:i] + rng.choice("ab") + a[i:] if rng.random() < 0.7 else "".join(rng.choice("ab") for _ in range(m + 1))
        x, y = spelling._letters([a], m + 1), spelling._letters([b], m + 1)
        prefix = next((k for k in range(m) if a[k] != b[k]), m)
        for lo in range(m + 1):
            for hi in range(lo, m + 1):
                if a[:lo] == b[:lo] and a[hi:] == b[hi + 1 :]:  # the block's words agree outside
                    assert bool(spelling.inserted(x, y, m, lo, hi)[0]) == (near(a, b) and lo <= prefix <= hi), (a, b, lo, hi)
