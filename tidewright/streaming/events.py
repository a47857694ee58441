"""Structured Streaming over events and query logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.text import LOG


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Counts and sums per window and event type; tumbling, or sliding with ``slide``."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if e.isStreaming else e
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("user_sum")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "user_sum")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Sessions of each user: runs of events with no pause of ``gap``."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if e.isStreaming else e
    return e.groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def replay(spark: SparkSession, path: str, schema, name: str, build, mode: str = "append", files: int = 1) -> DataFrame:
    """Run a folder of parquet files as a stream through ``build`` into a memory table, to its end."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def follow_log(spark: SparkSession, folder: str) -> DataFrame:
    """A growing JSON Lines query log as a stream."""
    return spark.readStream.schema(LOG).json(folder)
