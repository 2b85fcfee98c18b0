import numpy as np
import pytest
from graphspan.llm.components import connected_components
from graphspan.llm.embedding_dedup import cosine_links, itq_rotation, learn_quantiser

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, code string"


def brute(ids, x, threshold):
    ok = np.array([v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x])
    n = len(ids)
    link = np.zeros((n, n), bool)
    for i in np.flatnonzero(ok):
        for j in np.flatnonzero(ok):
            a, b = np.array(x[i], float), np.array(x[j], float)
            link[i, j] = i != j and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    least = np.array(ids)
    while True:
        new = np.array([min([least[i], *least[link[i]]]) for i in range(n)])
        if (new == least).all():
            return {v: (int(link[i].sum()), int(least[i])) for i, v in enumerate(ids)}
        least = new


def cases():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    near = [base[0] + rng.normal(size=16) * 0.08 for _ in range(30)]
    x = [v.astype(np.float32).tolist() for v in [*base, *near, base[1], base[1], base[2] * 3]]
    return x + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16]


@pytest.mark.parametrize("block", [512, 8])
def test_against_brute_force(spark, block):
    """block 8 also takes entries apart into blocks."""
    x = cases()
    ids = [3 * i + 5 for i in range(len(x))]
    rows = spark.createDataFrame([(i, v, 0, 1, "c") for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in cosine_links(rows, block=block).collect()}
    want = brute(ids, x, 0.95)
    links = sum(n for n, _ in want.values())
    assert links > 100 and sum(n for n, _ in got.values()) >= 0.9 * links
    assert all(got[i][0] <= want[i][0] for i in ids)  # nothing below the threshold
    assert got == want


def cloud(kind, n=3000, d=64):
    """Vectors with a partner each at a cosine from 0.95 to 0.97."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d))
    if kind == "off-centre":
        x += 2.0
    if kind == "clustered":
        x = rng.normal(size=(20, d))[rng.integers(0, 20, n)] * 2 + x * 0.8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=(n, d))
    if kind == "off-centre":
        u += rng.normal(size=(n, 1))
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.97, size=(n, 1))
    return np.concatenate([x, c * x + np.sqrt(1 - c * c) * u])


@pytest.mark.parametrize("kind", ["isotropic", "off-centre", "clustered"])
def test_recall_against_all_rows(spark, kind):
    x = cloud(kind)
    rows = spark.createDataFrame([(i, v, 0, 1, "c") for i, v in enumerate(x.tolist())], SCHEMA.replace("array<float>", "array<double>"))
    got = sum(r.n_links for r in cosine_links(rows).select("n_links").collect())
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int((x @ x.T >= 0.95).sum()) - len(x)
    assert want >= 6000 and 0.99 * want <= got <= want


def test_repeated_ids_and_ties(spark):
    """Rows that repeat an id are vectors of their own; equal vectors link with one another."""
    rows = spark.createDataFrame([(7, [1.0, 0.0], 0, 1, "c"), (7, [1.0, 0.0], 0, 1, "c"), (7, [0.0, 1.0], 0, 1, "c"), (9, [2.0, 0.0], 0, 1, "c")], SCHEMA)
    assert sorted(map(tuple, cosine_links(rows).collect())) == [(7, 0, 7, True), (7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False)]


def test_empty_and_linkless(spark):
    assert cosine_links(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in cosine_links(spark.createDataFrame([(1, None, 0, 0, "")], SCHEMA)).collect()] == [(1, 0, 1, True)]


def test_codes_are_balanced_and_the_rotation_is_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = itq_rotation(x, rng)
    assert np.allclose(r @ r.T, np.eye(16), atol=1e-9)
    q = learn_quantiser(x, len(x), 0.95)
    bits = (x - q.mean) @ q.axes > 0
    assert (abs(bits.mean(axis=0) - 0.5) < 0.1).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (500, 500)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and {got[100], got[101], got[102]} == {100} and got[500] == 500
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
