"""Replacing a table's rows: all of them, or those of the time partitions that the new rows touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Invalid, Unsupported
from .dml import CHANGE

PARTS = ("HOUR", "DAY", "MONTH", "YEAR")


def partition_of(column: Column, kind: str, part: str) -> Column:
    """The start of the value's partition; a TIMESTAMP's is in UTC (the session's zone)."""
    if part not in PARTS:
        raise Invalid(f"bad partition {part!r}")
    if kind == "DATE" and part == "HOUR":
        raise Invalid("a DATE has no hours")
    if kind not in ("DATE", "DATETIME", "TIMESTAMP"):
        raise Unsupported(f"{kind} isn't a time partition's type")
    return F.date_trunc(part, column)


def touched(source: DataFrame, field: str, kind: str, part: str) -> DataFrame:
    """``__p``: the partitions that the source has rows of, each once."""
    return source.select(partition_of(F.col(field), kind, part).alias("__p")).where(F.col("__p").isNotNull()).distinct()


def hit(target: DataFrame, source: DataFrame, field: str, kind: str, part: str) -> DataFrame:
    """The target's rows that a partition overwrite deletes."""
    return target.withColumn("__p", partition_of(F.col(field), kind, part)).join(touched(source, field, kind, part), "__p", "left_semi").drop("__p")


def dynamic(target: DataFrame, source: DataFrame, field: str, kind: str, part: str) -> DataFrame:
    """The target's rows of untouched partitions and all source rows, the latter marked as inserted.

    Rows without a partition never match: the target's stay, the source's are added. The touched partitions
    are an anti-join, so Spark broadcasts them when they are few and shuffles when they aren't.
    """
    keyed = target.withColumn("__p", partition_of(F.col(field), kind, part))
    stays = keyed.join(touched(source, field, kind, part), "__p", "left_anti").select(*target.columns, F.lit(0).alias(CHANGE))
    return stays.unionByName(source.select(*target.columns, F.lit(2).alias(CHANGE)))
