"""Functions whose results differ between GoogleSQL and Spark, as Columns of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("MICROSECOND", "MILLISECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")


def ceil(x: Column) -> Column:
    """As a double."""
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    """As a double."""
    return F.floor(x).cast("double")


def to_int64(x: Column) -> Column:
    """CAST to INT64 of a number: halves away from zero, where Spark truncates."""
    return F.round(x).cast("long")


def safe_divide(x: Column, y: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def trunc(x: Column, part: str, kind: str) -> Column:
    """DATE_TRUNC and its kin: the result has the value's type, where Spark always gives a TIMESTAMP."""
    if part not in PARTS:
        raise ValueError(f"bad part {part!r}")
    return F.date_trunc(part, x).cast({"DATE": "date", "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp"}[kind])


def in_unnest(x: Column, array: Column) -> Column:
    """False where nothing matches, nulls among the elements or not."""
    return F.coalesce(F.exists(array, lambda e: e == x), F.lit(False))


def array_agg(x: Column, distinct: bool = False, respect_nulls: bool = False) -> Column:
    """Spark's aggregates drop nulls; a record that holds one stays."""
    if respect_nulls:
        collect = F.collect_set if distinct else F.collect_list
        return F.transform(collect(F.struct(x.alias("x"))), lambda e: e["x"])
    return F.collect_set(x) if distinct else F.collect_list(x)


def to_json(x: Column, scalar: bool = False) -> Column:
    """With null fields; Spark takes no scalars, so one goes through an array of it."""
    options = {"ignoreNullFields": "false"}
    if not scalar:
        return F.to_json(x, options)
    made = F.to_json(F.array(x), options)
    return made.substr(F.lit(2), F.length(made) - 2)
