"""Event-time operators; each works on a stream and on a table alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, at: str, late: str, length: str, slide: str | None, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Tumbling (no slide) or sliding windows; rows later than ``late`` are dropped from a stream's state."""
    rows = df.withWatermark(at, late) if df.isStreaming else df
    out = rows.groupBy(F.window(at, length, slide or length).alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, at: str, late: str, gap: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Windows that end after a gap without rows of the group."""
    rows = df.withWatermark(at, late) if df.isStreaming else df
    out = rows.groupBy(F.session_window(at, gap).alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])


def deduplicated(df: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """One row per key; a stream remembers keys for as long as the watermark allows."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into Parquet and read it back."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
