"""Incremental runs of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def progress_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by window and type, final when the watermark has passed."""
    rows = events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def watch_folder(spark: SparkSession, path: str, checkpoint: str, compare: Callable[[DataFrame, int], None], schema: str = "pair_id string, side string, doc_id string, page int, text string") -> StreamingQuery:
    """Runs `compare` on each new batch of JSON pages; a batch is repeated after a failure, so it should overwrite its own sessions."""
    pages = spark.readStream.schema(schema).json(path)
    return pages.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frames(events: DataFrame) -> DataFrame:
    """Progress events (event, and other columns) as server-sent frames."""
    from palimpsest.functions.ids import sse_frame

    return events.select(sse_frame(F.col("event"), F.to_json(F.struct(*[c for c in events.columns if c != "event"]))).alias("frame"))
