"""Streaming counterparts: idempotent ingest and windowed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def read_files(spark: SparkSession, path: str, schema: str, files: int = 10) -> DataFrame:
    """A landing folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, key: str, value: str, size: str = "1 hour", slide: str | None = None, delay: str | None = "1 hour") -> DataFrame:
    """Count and extremes of ``value`` by key and tumbling (or sliding) window; ``delay`` None keeps the stream's own watermark."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    found = (stream.withWatermark(time, delay) if delay else stream).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return found.select(c("w.start").alias("start"), c("w.end").alias("end"), key, "n", "low", "high")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    found = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(c("w.start").alias("start"), c("w.end").alias("end"), key, "n")
