"""Scoring a stream of documents: each micro-batch is anti-joined with what is stored and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.runs import resumable


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Starts a query that leaves one row per key in the Parquet table at path; a replayed batch adds nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: resumable(batch.sparkSession, batch, score, path, keys) and None).start()
