"""The Spark session the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set what the engine's semantics rest on: UTC, ANSI errors, the TIME type."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("basalt")
    base = {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    return configure(builder.config(map=base | SETTINGS | more).getOrCreate())
