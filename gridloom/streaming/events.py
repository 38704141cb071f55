"""Streams beside the batch surface (extensions): windowed counts of events, and verdicts that settle as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """New files of a folder as a stream; ts becomes an instant, as watermarks need one."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value) by tumbling windows, or sliding ones; rows later than ``late`` are left out."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of a user's events no further apart than ``gap``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    rows = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it gave."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def settle(stream: DataFrame, folder: str, checkpoint: str, fold: Callable[[DataFrame], DataFrame]):
    """Append each micro-batch, already folded to one row a key, to a log; readers fold the log again. A repeated batch writes the same folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
