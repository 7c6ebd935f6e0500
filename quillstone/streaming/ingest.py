"""Append-only ingest: each record once, files read as they come, state bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, time: str, lateness: str = "30 days") -> StreamingQuery:
    """Append new rows of the Parquet files below ``source`` to ``target``, one per ``key`` within ``lateness`` of event time.

    Resumes from ``checkpoint``: a row is written once, whatever stops the query. Runs on what is there and ends.
    """
    rows: DataFrame = spark.readStream.schema(schema).parquet(source)
    once = rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, time: str, by: str, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Counts per tumbling window and ``by``, for streams as for tables."""
    from pyspark.sql import functions as F

    return rows.withWatermark(time, lateness).groupBy(F.window(time, width), by).count().select(F.col("window.start").alias("window_start"), by, "count")
