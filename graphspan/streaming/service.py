"""A long-running service: files that arrive in a folder are answered by a batch query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


def serve(spark: SparkSession, requests: str, schema: str, answer: Callable[[DataFrame], DataFrame], answers: str, state: str, once: bool = False) -> StreamingQuery:
    """Runs `answer` over each batch of new JSON request files and writes its rows under answers.

    A batch that is run again after a failure overwrites its own folder, so each
    request is answered once.  once: ends when the files present are answered.
    """

    def one(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{answers}/batch={number}")

    writer = spark.readStream.schema(schema).json(requests).writeStream.foreachBatch(one).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
