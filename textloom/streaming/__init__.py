"""Structured Streaming: files converted as they are dropped, and windowed counts of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.sources import files


def convert_dropped(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Convert new files of a folder to Markdown rows in Parquet, once each."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = files.convert(stream.select("path", "content", "length"))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) counted by window and type; works on streams and tables."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_windows(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) counted by overlapping windows and type; works on streams and tables."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events (ts, user_id, value) less than gap apart, with their bounds, count and sum."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("ts").alias("last"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "last", "n", "total")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Events without repeats of a key; on a stream, repeats within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total after each micro-batch: state kept by user for good, updated in Arrow batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key, batches, state: GroupState):
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "append", GroupStateTimeout.NoTimeout)


def convert_batches(spark: SparkSession, folder: str, each, checkpoint: str) -> StreamingQuery:
    """New files of a folder converted batch by batch; each(results, batch number) is called with every batch."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = files.convert(stream.select("path", "content", "length"))
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict:
    """Batch number, rows of the last batch, rows a second and whether the query still runs."""
    last = query.lastProgress or {}
    return {"batch": last.get("batchId"), "rows": last.get("numInputRows"), "rows_per_second": last.get("processedRowsPerSecond"), "active": query.isActive}


def cancel(query: StreamingQuery, timeout: float = 30.0) -> bool:
    """Stop a query between batches; whether it ended in time. What was written stays, and a restart goes on from its checkpoint."""
    query.stop()
    query.awaitTermination(timeout)
    return not query.isActive
