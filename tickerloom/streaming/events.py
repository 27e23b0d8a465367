"""Bars from an event stream: event time, a watermark, no event twice, late events left out.

Events may come again and out of order.  An event that is older than the watermark (the latest event
time of earlier batches less the delay) is late and dropped; a repeated event is
dropped as long as its first copy can be remembered, which is as long as it
is not late.  A window's bar is written once, when the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
DELAY, SIZE = "6 hours", "1 hour"


def windowed_bars(events: DataFrame, delay: str = DELAY, size: str = SIZE) -> DataFrame:
    """(event_type, start, open, high, low, close, volume, events) per window of event time.

    Works on streams and tables alike; a table has no late events.  The first and last event of a window
    go by (time, id).  Events without id, time or value are left out.
    """
    known = events.where("event_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL")
    once = known.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else known.dropDuplicates(["event_id"])
    order = F.struct("ts", "event_id")
    bars = once.groupBy(F.window("ts", size).alias("w"), "event_type").agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.sum("value").alias("volume"), F.count(F.lit(1)).alias("events"))
    return bars.select("event_type", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "events")


def take_landed(spark: SparkSession, landing: str, out: str, checkpoint: str, delay: str = DELAY, size: str = SIZE) -> None:
    """Work off what has landed since the last call, in one batch, and return; bars are appended to ``out`` exactly once."""
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(landing)
    query = (
        windowed_bars(events, delay, size).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
