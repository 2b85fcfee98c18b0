"""From raw documents to token ids: toxicity, near duplicates, secrets, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's documents.  All stages but
the last return the columns of docs, whatever further columns docs has and
whatever their names; an empty table gives an empty result; texts are taken whole.
"""

from __future__ import annotations

import uuid

from graphspan.llm.bpe import bpe_encode
from graphspan.llm.common import remainder, remove, shared_folder
from graphspan.llm.mixing import mixed_rows
from graphspan.llm.near_dedup import drop_near_duplicates
from graphspan.llm.queries import vocabulary
from graphspan.llm.secrets import redact_secrets
from graphspan.llm.toxicity import drop_toxic
from pyspark.sql import DataFrame, SparkSession

#: Documents that score so much are rejected.
TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under TOXIC; labels of the held-out fifth are not used.

    Null and empty texts stay, they have no toxic segment; rows that repeat an id
    or a text are judged each by its text, equal ones alike; rows without an id stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, labels, remainder("doc_id", 5) != 0, TOXIC)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates.

    Texts without words are linked with nothing and stay.  Rows that repeat an id
    are one document, of which the text with the least hash stays; rows without
    an id stay.
    """
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind and n_chars by the new length.

    Null texts stay null; repeated rows stay repeated, changed alike.
    """
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Texts without words are never taken.  A null source is a source of its own.
    Rows that repeat an id share one random number; equal ranks are taken together.
    """
    return mixed_rows(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every document, and a digest of what they decode to; null texts have no tokens, repeated rows equal ones."""
    return bpe_encode(docs, vocabulary(), keep=["doc_id", "lang", "source"], outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("bpe", bpe)]

#: SQL cannot express the stages; tests hold each against a plain Python version of its decision.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, with the rows between them in the shared folder; a stage's input is deleted once its output is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
