"""Structured Streaming over event rows (event_id, ts, user_id, event_type, value). Extras of this engine.

The functions take a streaming or a batch DataFrame alike; watermarks only matter for streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _stamped(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _windowed(grouped, value: str = "value") -> DataFrame:
    out = grouped.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    ends = {"window_start": F.col("window.start").cast("timestamp_ntz"), "window_end": F.col("window.end").cast("timestamp_ntz")}
    return out.withColumns(ends).drop("window")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return _windowed(_stamped(events, late).groupBy(F.window("ts", width), "event_type"))


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return _windowed(_stamped(events, late).groupBy(F.window("ts", width, step), "event_type"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    grouped = _stamped(events, late).groupBy(F.session_window("ts", gap).alias("window"), "user_id")
    return _windowed(grouped)


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    rows = _stamped(events, late)
    return rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])


def session_rows(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Batch form of sessions with windows: each event with the number of its user's session.

    Times are rounded to whole seconds, halves to the even one.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = lambda ts: F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("long")
    apart = seconds(F.col("ts")) - seconds(F.lag("ts").over(w))
    new = F.when(apart.isNull() | (apart >= gap_minutes * 60), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w)).drop("_new")


def read_stream(spark: SparkSession, folder: str, schema, files: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files that come into a folder; ``files`` is a pattern of their names, for a folder that holds others."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def write_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Everything available now into Parquet, exactly once across restarts."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
