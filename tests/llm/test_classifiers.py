"""Quality and toxicity: held-out accuracy, defined results for odd rows."""

import random

import pytest
from graphspan.llm import quality, toxicity
from graphspan.llm.common import remainder
from pyspark.sql import functions as F

DOC = "doc_id long, text string, score string, k0 string"


def brute_segments(scores):
    """All maximal-scoring segments, by taking the best segment and searching both sides of it."""
    if not scores or max(scores) <= 0:
        return []
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if best is None or total > best[0] + 1e-12:
                best = (total, a, b + 1)
    total, a, b = best
    return brute_segments(scores[:a]) + [(a, b, total)] + [(x + b, y + b, t) for x, y, t in brute_segments(scores[b:])]


def test_maximal_segments_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(0, 14)
        # scores whose sums differ, so that the segments are unique
        scores = [rng.choice([1, 2, 3]) + i * 1e-3 if rng.random() < 0.4 else -0.7 for i in range(n)]
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], 0.7)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x - y) < 1e-9 for (_, _, x), (_, _, y) in zip(got, want, strict=True))


def corpus(spark, kind):
    rng = random.Random(1)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(clean) for _ in range(60)]
        bad = i % 3 == 0
        if bad and kind == "toxic":
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["vileword", "nastyword", "foulword"])
        if bad and kind == "quality":
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        rows.append((i, " ".join(words), "clash", "clash"))
        labels.append((i, int(bad) if kind == "toxic" else int(not bad)))
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, f"doc_id long, {kind} int")


@pytest.mark.parametrize("kind,score", [("toxic", toxicity.score_toxicity), ("quality", quality.score_quality)])
def test_held_out_accuracy(spark, kind, score):
    docs, labels = corpus(spark, kind)
    out = score(docs, labels, remainder("doc_id", 4) != 2).where(remainder("doc_id", 4) == 2).join(labels, "doc_id").toPandas()
    assert len(out) > 50
    assert ((out["score"] >= 0.5) == (out[kind] == 1)).mean() > 0.95


@pytest.mark.parametrize("kind,score", [("toxic", toxicity.score_toxicity), ("quality", quality.score_quality)])
def test_odd_rows(spark, kind, score):
    docs, labels = corpus(spark, kind)
    odd = spark.createDataFrame([(9001, None, None, None), (9002, "", "", ""), (None, "text", None, None), (9003, "word " * 100_000, None, None), (9001, None, None, None)], DOC)
    labels = labels.union(spark.createDataFrame([(None, 1), (5, None), (6, 7), (7, 1), (7, 0)], labels.schema))
    out = score(docs.union(odd), labels, F.lit(True)).toPandas()
    assert len(out) == 405 and out["score"].between(0, 1).all()
    blank = out[out["doc_id"].isin([9001, 9002])]["score"]
    assert len(blank) == 3 and blank.nunique() == 1


@pytest.mark.parametrize("kind,score", [("toxic", toxicity.score_toxicity), ("quality", quality.score_quality)])
def test_empty_tables(spark, kind, score):
    docs, labels = corpus(spark, kind)
    assert score(docs.where("false"), labels, F.lit(True)).count() == 0
    assert score(docs, labels.where("false"), F.lit(True)).toPandas()["score"].nunique() == 1


def test_dictionaries_of_all_blocks(spark):
    """A group holds all blocks of a small sample; of a large one every group's words come into the dictionary."""
    import random

    import zstandard

    rng = random.Random(4)
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(40)] for _ in range(6)]
    kinds = [[" ".join(rng.choices(ws, k=60)).encode() for _ in range(50)] for ws in words]
    flat = [b for blocks in kinds for b in blocks]
    rows = spark.createDataFrame([(bytearray(b), i * 7919) for i, b in enumerate(flat)], "block binary, place bigint")
    plain = quality.dictionary_of(rows)
    u = {b: k for b, k in ((bytes(r[0]), r[1]) for r in rows.select("block", F.xxhash64(F.lit(5), "block")).collect())}
    assert plain == quality.train_dictionary(sorted(flat, key=lambda b: (u[b], b)))
    many = quality.dictionary_of(rows, group_blocks=60)
    assert 0 < len(many) <= quality.DICT_BYTES
    sizes = lambda d, blocks: sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d)).compress(b)) for b in blocks)
    for blocks in kinds:
        assert sizes(many, blocks) < 0.8 * sum(len(zstandard.ZstdCompressor().compress(b)) for b in blocks)
    assert quality.dictionary_of(rows.where("false")) == b""


def test_tiny_blocks_go_into_the_dictionary():
    assert quality.train_dictionary([b"ab", b"cd"]) == b"abcd"
    assert quality.train_dictionary([b"long enough", b"ab", b"long enough", b"cd"]) == b"long enoughlong enoughabcd"
    assert quality.train_dictionary([b"the same block"] * 3) == b"the same block"


def test_quality_scores_against_plain_compression(spark):
    """Every score from four sizes per block, taken with compressors of the test's own."""
    import math

    import zstandard
    from graphspan.llm.labelled import labelled_texts

    docs, labels = corpus(spark, "quality")
    long = spark.createDataFrame([(5000, "abc hgf " * 900 + "###", None, None), (5001, None, None, None)], DOC)
    docs = docs.union(long)
    model = quality.fit_quality(*labelled_texts(docs, labels, "quality", F.lit(True)))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels, F.lit(True)).collect()}
    options = dict(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    kinds = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **options) for d in (model.good, model.bad)] + [zstandard.ZstdCompressor(**options)]
    for i, text in docs.select("doc_id", "text").collect():
        data = (text or "").encode()
        x = [0.0] * 9
        if data:
            cuts = [k for k in range(0, len(data), 2048) if k == 0 or len(data) - k > 512]
            blocks = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
            g, b, p = ([len(c.compress(x)) for x in blocks] for c in kinds)
            raw = [len(x) + 12 for x in blocks]
            nd = lambda u, v: (u - v) / (u + v)
            each = [nd(v, u) for u, v in zip(g, b, strict=True)]
            x = [nd(sum(b), sum(g)), nd(sum(p), sum(g)), nd(sum(p), sum(b)), nd(sum(raw), min(sum(g), sum(b))), nd(sum(raw), sum(p)), min(each), max(each)]
            x += [max(nd(r, min(u, v)) for r, u, v in zip(raw, g, b, strict=True)), max(nd(r, u) for r, u in zip(raw, p, strict=True))]
        z = model.curve[0] + sum(c * 10 * v for c, v in zip(model.curve[1:], x, strict=True))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_toxicity_scores_against_plain_segments(spark):
    import math

    from graphspan.llm.labelled import labelled_texts

    docs, labels = corpus(spark, "toxic")
    model = toxicity.fit_toxicity(*labelled_texts(docs, labels, "toxic", F.lit(True)))
    assert {"vileword", "nastyword", "foulword"} <= set(model.weights)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels, F.lit(True)).collect()}
    for i, text in docs.select("doc_id", "text").collect():
        words = text.split()
        scores = [model.weigh(w) or -model.drift for w in words]
        worth = [max(0.0, model.lam * t - math.log(model.k * max(20, len(words)))) for _, _, t in brute_segments(scores)]
        z = model.curve[0] + model.curve[1] * max(worth, default=0) + model.curve[2] * math.log1p(sum(worth))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_very_long_labelled_texts_and_copies_count(spark):
    """A term that only a labelled text of 1 MB and its likes have is learnt; copies of one text are one vote."""
    long = [(i, f"padding{i} " * 100_000 + f"rareword rareword{i}" if i == 0 else f"rareword in text {i} " + " ".join(f"z{i * 9 + j}" for j in range(9)), None, None) for i in range(30)]
    copies = [(100 + i, "copyword chance in one text that is spread by copies of itself all over the place", None, None) for i in range(30)]
    clean = [(200 + i, " ".join(f"y{i * 13 + j}" for j in range(15)), None, None) for i in range(100)]
    docs = spark.createDataFrame(long + copies + clean, DOC)
    labels = spark.createDataFrame([(r[0], int(r[0] < 200)) for r in long + copies + clean], "doc_id long, toxic int")
    from graphspan.llm.labelled import labelled_texts, shares_of_copies

    sample, counts = labelled_texts(docs, labels, "toxic", F.lit(True))
    assert sample.count() == 160 and counts == {0: 100, 1: 60}
    shares = shares_of_copies(sample)
    assert abs(sum(shares[i] for i in range(100, 130)) - 1) < 1e-9 and shares[0] == 1.0
    model = toxicity.fit_toxicity(sample, counts)
    assert "rareword" in model.weights and "copyword" not in model.weights


def test_an_id_with_several_texts_is_trained_on_the_same_one(spark):
    from graphspan.llm.labelled import labelled_texts

    rows = [(1, f"text {i}", None, None) for i in range(20)]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    picks = {labelled_texts(spark.createDataFrame(rows[k:] + rows[:k], DOC).repartition(3), labels, "toxic", F.lit(True))[0].first()["t"] for k in range(3)}
    assert len(picks) == 1
