"""Streams of events: daily usage, first sight of a key, changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 300) -> DataFrame:
    """Parquet files of ``folder`` as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and their value by day and type; rows over ``late`` behind are dropped in a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def first_seen(events: DataFrame, keys: list[str], within: str = "1 minute") -> DataFrame:
    """One event per key and ``within`` of a stream, as a throttle of attempts."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, through the streaming engine, as a table in memory (tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
