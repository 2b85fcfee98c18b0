"""Each stage of the pipeline against a plain version of its decision."""

import os

import corpus_pipeline
import pytest
from graphspan.llm import secrets
from graphspan.llm.bpe import WordBpe
from graphspan.llm.queries import vocabulary

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], FOLDER).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == columns
    raw, clean, single, redacted, mixed, ids = ([r.asDict() for r in x.collect()] for x in seen)
    assert 0.8 * len(raw) < len(clean) <= len(raw)
    assert {r["doc_id"] for r in single} <= {r["doc_id"] for r in clean}
    lowered = [r["text"].lower().split() for r in single]
    assert len({tuple(w) for w in lowered}) == len(lowered)  # exact copies are gone
    assert {r["doc_id"] for r in redacted} == {r["doc_id"] for r in single}
    assert not any(secrets.find_secrets(r["text"]) for r in redacted)
    size = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(size(mixed) - size(redacted)) < 0.25 * size(redacted)
    bpe = WordBpe(vocabulary())
    want = sorted((r["doc_id"], bpe.encode(r["text"])) for r in mixed)
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in ids) == want


def test_run_gives_the_same_rows(spark):
    first = corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens", "decoded_sha256").collect()
    second = corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens", "decoded_sha256").collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, second)) and first
