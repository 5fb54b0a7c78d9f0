"""Streaming front end: uploads that arrive as files are resolved batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablewright.sources.requests import normalised, records


def stream_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Normalised requests of the JSON files that appear under path."""
    return normalised(records(spark.readStream.text(path, wholetext=True), "value"))


def run_uploads(
    requests: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Start handle on every micro-batch of requests; it sees each batch at least once."""
    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
