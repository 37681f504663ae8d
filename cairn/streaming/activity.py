"""Learner activity from an event stream: an extension, watermarked and windowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    r = r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r
    return r.parquet(path)


def activity(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) a window; works on a stream and on a table alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
