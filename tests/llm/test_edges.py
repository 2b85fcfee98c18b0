"""Very long texts, ties and very many equal rows, where no other test has them."""

import random

from graphspan.llm import embedding_dedup, mixing, near_dedup, repeats, secrets
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, n_chars long, size long, spans string, kept string, taken string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, None if t is None else len(t), 7, "clash", "clash", "clash") for i, t, s in rows], SCHEMA)


def long_text(seed, n=150_000):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))


def test_a_megabyte_of_text(spark):
    a, b = long_text(1), long_text(2)
    assert len(a) > 1_000_000
    shared = a[500_000:500_600]
    near = a[:-2000] + " changed words at the end"
    rows = docs_of(spark, [(1, a, "x"), (2, near, "x"), (3, b[:700_000] + shared + b[700_000:], "y"), (4, b + " token=abcdefgh99 " + b, "y"), (5, "short", "y"), (6, None, None)])
    out = {r.doc_id: r for r in near_dedup.near_duplicates(rows).collect()}
    assert out[2].component_id == 1 and not out[2].kept and out[3].component_id == 3 and out[6].component_id == 6
    assert out[1].n_shingles > 140_000
    spans = {r.doc_id: r.spans for r in secrets.secret_spans(rows).collect()}
    assert [(s["kind"], s["start"]) for s in spans[4]] == [("assign", len(b) + 1)] and not spans[1]
    mixed = {r.doc_id: r for r in mixing.pareto_mix(rows).collect()}
    assert mixed[1]["size"] == 150_000 and mixed[6]["taken"] == 0
    gone = {r.doc_id: sum(x.hi - x.lo for x in r.runs) for r in repeats.remove_repeats(rows).collect()}
    assert gone[1] >= len(near) - 100 and gone[5] == 0
    assert gone[4] > 2 * len(b) - 3000  # twice the same text in one document, and in the third


def test_a_thousand_equal_rows(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, other = prose(200), prose(80)
    text = prose(30) + " " + passage + " " + prose(30)
    rows = [(None if i % 2 else 7, text, "s") for i in range(1000)] + [(8, prose(20) + " " + passage, "s"), (9, other, "s")]
    out = repeats.remove_repeats(docs_of(spark, rows)).collect()
    assert len(out) == 1002
    whole = [r for r in out if r.n_bytes == len(text)]
    assert len(whole) == 1000 and all([(x.lo, x.hi) for x in r.runs] == [(0, len(text))] for r in whole)
    eight = next(r for r in out if r.doc_id == 8)
    assert sum(x.hi - x.lo for x in eight.runs) >= len(passage) and next(r for r in out if r.doc_id == 9).runs == []
    # spans of equal rows come together once
    spans = repeats.repeated_spans(docs_of(spark, rows).select(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("text").alias("h"), F.col("text").alias("t")))
    assert max(len(r.spans) for r in spans.collect()) < 50
    near = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert len(near) == 1002 and {r.component_id for r in near if r.doc_id == 7} == {7}


def test_equal_ranks_and_repeated_rows_are_taken_together(spark):
    rows = [(5, "one two three", "a")] * 40 + [(i, "four five", "a") for i in range(100, 140)] + [(i, "six", "b") for i in range(40)] + [(None, "seven", None)] * 3
    first = mixing.pareto_mix(docs_of(spark, rows)).collect()
    again = mixing.pareto_mix(docs_of(spark, rows[::-1])).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == len(rows)
    assert len({r.taken for r in first if r.doc_id == 5}) == 1
    assert sorted(mixing.mixed_rows(docs_of(spark, rows)).columns) == sorted(docs_of(spark, rows).columns)


def test_vectors_without_order(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 2)], "c", "c") for i in range(60)], "vec_id long, embedding array<float>, owner string, bits string")
    out = {r.vec_id: r for r in embedding_dedup.cosine_links(rows).collect()}
    assert all(r.n_links == 29 and r.component_id == r.vec_id % 2 and r.kept == (r.vec_id < 2) for r in out.values())
