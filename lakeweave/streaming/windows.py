"""Structured Streaming forms: event-time windows, keyed state, idempotent delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream; watermarks need instants, so ``ts`` gets the session's zone."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by window and kind; state older than the watermark goes."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select("w.start", "event_type", "n")


def once(events: DataFrame, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, within the watermark: at-least-once delivery made idempotent."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def deliver(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every batch of what is there now, then ends; the checkpoint is the consumer's cursor."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
