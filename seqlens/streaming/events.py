"""Streams: event counts over windows with watermarks, and batches of a stream through the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by type in tumbling or sliding windows; rows later than the watermark are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")


def sessions(stream: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(key, s.alias("s")).agg(F.count("*").alias("n")).select(key, "s.start", "s.end", "n")


def by_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Each micro-batch through a batch plan; the checkpoint makes restarts resume where they were."""
    return stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What is there so far, as Parquet: a row once it can't change any more. Resumes where the checkpoint ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
