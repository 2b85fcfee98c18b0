"""Bounds of time and memory on bad cases: crowded buckets, adversarial long texts, vectors without ids or of few dimensions."""

import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from graphspan.llm import near_dedup, secrets, toxicity
from graphspan.llm.embedding_dedup import cosine_links


def registers_of(rng, rows, sets=None):
    return np.frombuffer(b"".join(near_dedup.registers(np.unique(rng.integers(0, 1 << 62, 40, dtype=np.uint64))).tobytes() for _ in range(rows)), np.uint16).reshape(rows, -1)


def test_a_piece_with_very_many_guests_takes_little_memory():
    """20 000 unlike members of one bucket, 200 of them at home: what is allocated follows home times strip."""
    rng = np.random.default_rng(1)
    regs = np.tile(registers_of(rng, 400), (50, 1))
    n = rng.integers(30, 60, 20_000)
    comp, guest = np.arange(20_000), np.ones(20_000, bool)
    guest[:200] = False
    few = np.repeat(regs[:1], 20_000, axis=0)
    few[:, :] = rng.integers(0, 1 << 16, few.shape, dtype=np.uint16)
    tracemalloc.start()
    i, _, _ = near_dedup.promising_pairs(few, n, comp, guest)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == 0 and peak < 200_000_000


@pytest.mark.parametrize("piece,strip", [(256, 4096), (3, 5)])
def test_pairs_of_strips_are_those_of_the_whole(monkeypatch, piece, strip):
    monkeypatch.setattr(near_dedup, "PIECE", piece)
    monkeypatch.setattr(near_dedup, "STRIP", strip)
    rng = np.random.default_rng(2)
    n, comp, guest = rng.integers(5, 12, 90), rng.integers(0, 12, 90), rng.random(90) < 0.6
    got = [(min(x, y), max(x, y)) for i, j in near_dedup.sized_pairs(n, comp, guest, 75) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
    want = [(i, j) for i in range(90) for j in range(i + 1, 90) if 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j]) and comp[i] != comp[j] and not (guest[i] and guest[j])]
    assert sorted(got) == want
    got = [(x, y) for i, j in near_dedup.sized_pairs(n, None, None, 75) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(got) == [(i, j) for i in range(90) for j in range(i + 1, 90) if 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j])]


def seconds(f):
    began = time.process_time()
    f()
    return time.process_time() - began


def test_segments_in_linear_time():
    """Falling sums keep all candidates open; the walk back over them would be quadratic."""
    rng = random.Random(3)
    hits = [(40 * i, 1.0 + rng.random()) for i in range(40_000)]
    assert seconds(lambda: toxicity.maximal_segments(hits)) < 2
    rising = [(i, 1.0) for i in range(200_000)]
    assert toxicity.maximal_segments(rising) == [(0, 200_000, pytest.approx(200_000.0))]


def test_segments_are_those_of_the_definition():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-0.75, -0.75, 0.5, 1.5, 3.0]) if rng.random() < 0.7 else -0.75 for _ in range(rng.randint(0, 25))]
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        # a segment is maximal if all its proper parts score less and no longer one with that property holds it
        good = [(a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1) if all(sums[a] < sums[k] for k in range(a + 1, b + 1)) and all(sums[k] < sums[b] for k in range(a, b))]
        want = [(a, b) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good)]
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], 0.75)
        assert [(a, b) for a, b, _ in got] == sorted(want)


JWT = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")


def test_web_tokens_are_those_of_the_pattern():
    rng = random.Random(5)
    parts = ["eyJ", "a" * 9, "b" * 10, ".", ".", " ", "-_", "eyJabcdefghij", "c" * 25, "\n", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert secrets.jwt_spans(text) == [m.span() for m in JWT.finditer(text)], text


@pytest.mark.parametrize("text", ["eyJ" * 350_000, "eyJaaaaaaaaaa." * 70_000, ("eyJ" * 5 + ".") * 60_000, "token" * 200_000, "password " * 110_000, "AKIA" * 250_000, "ghp_" * 250_000, "xoxb-" * 200_000, "abcdef0123" * 100_000])
def test_a_megabyte_that_looks_like_secrets(text):
    assert seconds(lambda: secrets.find_secrets(text)) < 4


SCHEMA = "vec_id long, embedding array<double>"


def test_vectors_without_an_id(spark):
    big = 2**60 + 1
    rows = [(None, [1.0, 2.0, 3.0]), (big, [1.0, 2.0, 3.001]), (None, [-1.0, 5.0, 0.0]), (None, [-1.0, 5.0, 0.01]), (4, [9.0, -3.0, 0.5]), (None, [9.0, -3.0, 0.5])]
    got = sorted(map(tuple, cosine_links(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = [(None, 1, big, True), (big, 1, big, True), (None, 1, None, True), (None, 1, None, True), (4, 1, 4, True), (None, 1, 4, True)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("dim", [1, 2, 4, 8])
def test_recall_in_few_dimensions(spark, dim):
    """Off-centre vectors, all in a cone: tables are added, and their codes shortened, until pairs at the threshold meet."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000 if dim > 2 else 700, dim)) + 1.0
    got = {r.vec_id: r.n_links for r in cosine_links(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], SCHEMA)).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in range(len(x)))
