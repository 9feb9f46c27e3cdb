"""As-of and range joins without a product of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, take: list[str], by: str | None = None) -> DataFrame:
    """Each left row with the columns ``take`` of the latest right row of its keys at or before it; nulls if none.

    Both sides are stacked, sorted once by key and time, and the last right row is carried forward: one
    shuffle, linear in both sides, where a join on the inequality makes every earlier pair. Of right rows at
    one time the one of the largest ``by`` (a column of the right side) counts.
    """
    carried = F.struct(F.col(right_at).alias("at"), *[F.col(c).alias(c) for c in take])
    rank = F.col(by) if by else F.lit(0)
    r = right.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(on)], F.col(right_at).alias("t"), F.lit(0).alias("side"), rank.cast("double").alias("tie"), carried.alias("r"), F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("l"))
    l = left.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(on)], F.col(left_at).alias("t"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("tie"), F.lit(None).cast(r.schema["r"].dataType).alias("r"), F.struct("*").alias("l"))
    order = Window.partitionBy(*[f"k{i}" for i in range(len(on))]).orderBy(F.col("t").asc_nulls_first(), "side", F.col("tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return r.unionByName(l).withColumn("last", F.last("r", ignorenulls=True).over(order)).where("side = 1").select("l.*", *[F.when(F.col("t").isNotNull(), F.col("last")[c]).alias(c) for c in take])


def in_range(points: DataFrame, ranges: DataFrame, at: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs with low <= at < high, by cells of ``width``: a range is in every cell it touches, a point in one.

    An equality join on the cell, so that Spark can shuffle it, with the exact condition after. Wide ranges
    against a small ``width`` make many rows: choose it near the usual length of a range.
    """
    p = points.withColumn("__cell", F.floor(at / width))
    r = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    return p.join(r, "__cell").where((at >= low) & (at < high)).drop("__cell")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark filters a window's rank before the shuffle too."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__nth") <= n).drop("__nth")
