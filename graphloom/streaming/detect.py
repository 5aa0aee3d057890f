"""Entity detection over a stream of questions: beyond the batch workloads, on the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.retrieval import detect_entities


def detect_stream(questions: DataFrame, catalog: DataFrame, path: str, checkpoint: str, key: str = "question_id", text: str = "question") -> StreamingQuery:
    """Write the entity found in each question of a stream to Parquet files, a folder for each micro-batch.

    A batch that runs again overwrites its own folder, so every question is written once.
    """

    def one(batch: DataFrame, number: int) -> None:
        detect_entities(batch, catalog, key, text).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
