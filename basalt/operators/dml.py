"""UPDATE, DELETE and MERGE as DataFrame rewrites of (a part of) a table into its next rows.

Every function returns the rows that stay, with ``CHANGE``: 0 as it was, 1 updated, 2 inserted. The writer
stores it beside the rows and counts it there, so a statement is evaluated once. Nothing here writes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Invalid


CHANGE = "__change"


@dataclass(frozen=True)
class Clause:
    """One WHEN of a MERGE: kind is matched, absent (in the target) or orphan (not in the source)."""

    kind: str
    action: str  # insert, update, delete
    condition: str | None = None
    values: tuple[tuple[str, str], ...] = ()  # column, expression


def delete(target: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition isn't TRUE stay."""
    return target.where(~F.coalesce(F.expr(condition), F.lit(False))).withColumn(CHANGE, F.lit(0))


def update(target: DataFrame, alias: str, assignments: list[tuple[str, str]], condition: str, source: DataFrame | None = None, source_alias: str = "", single: bool = False) -> DataFrame:
    """SET expressions may name the target's and the source's columns; several source rows for one row are an error.

    ``single`` says that no row has several: the join's rows then need no window.
    """
    names = target.columns
    unknown = [c for c, _ in assignments if c.lower() not in {n.lower() for n in names}]
    if unknown or len({c.lower() for c, _ in assignments}) != len(assignments):
        raise Invalid(f"bad SET columns: {', '.join(unknown) or 'one is set twice'}")
    to = {c.lower(): e for c, e in assignments}
    if source is None:
        hit = F.coalesce(F.expr(condition), F.lit(False))
        marked = target.alias(alias).withColumn("__hit", hit)
    else:
        left = target.withColumn("__row", F.monotonically_increasing_id()).alias(alias)
        marked = left.join(source.withColumn("__hit", F.lit(True)).alias(source_alias), F.expr(condition), "left")
        if not single:
            marked = marked.withColumn("__n", F.count("__hit").over(Window.partitionBy("__row")))
            several = F.raise_error(F.lit("UPDATE: several source rows match one target row")).cast("boolean")
            marked = marked.withColumn("__hit", F.when(F.col("__n") > 1, several).otherwise(F.col("__hit")))
        marked = marked.withColumn("__set", F.col("__hit").isNotNull())
    hit = F.col("__hit") if source is None else F.col("__set")
    return marked.select(*[(F.when(hit, F.expr(to[n.lower()])).otherwise(F.col(f"{alias}.{n}")) if n.lower() in to else F.col(f"{alias}.{n}")).alias(n) for n in names], hit.cast("int").alias(CHANGE))


def merge(target: DataFrame, source: DataFrame, alias: str, source_alias: str, on: str, clauses: list[Clause], single: bool = False) -> DataFrame:
    """A full outer join with match flags; each row takes the first clause of its kind whose condition holds.

    A target row that two source rows would change is an error; ``single`` says that none has two, and the join's
    rows then need no window. A constant FALSE condition isn't joined at all.
    """
    names = target.columns
    single = single or on.strip().upper() == "FALSE"
    if on.strip().upper() == "FALSE":
        both = _never(target, source, alias, source_alias)
    else:
        t = target.withColumn("__t", F.lit(True)).withColumn("__row", F.monotonically_increasing_id()).alias(alias)
        s = source.withColumn("__s", F.lit(True)).withColumn("__source_row", F.monotonically_increasing_id()).alias(source_alias)
        both = t.join(s, F.expr(on), "full")
    in_target, in_source = F.col(f"{alias}.__t").isNotNull(), F.col(f"{source_alias}.__s").isNotNull()
    kinds = {"matched": in_target & in_source, "absent": ~in_target & in_source, "orphan": in_target & ~in_source}
    chosen: Column = F.lit(-1)
    for i, c in reversed(list(enumerate(clauses))):
        holds = F.coalesce(F.expr(c.condition), F.lit(False)) if c.condition else F.lit(True)
        chosen = F.when(kinds[c.kind] & holds, F.lit(i)).otherwise(chosen)
    marked = both.withColumn("__chosen", chosen)
    # Rows by target row; source rows without one each by themselves, so that they aren't one group.
    row = Window.partitionBy(F.coalesce(f"{alias}.__row", -1 - F.col(f"{source_alias}.__source_row")))
    changed = F.sum(F.when((F.col("__chosen") >= 0) & kinds["matched"], 1).otherwise(0)).over(row)
    if any(c.kind == "matched" for c in clauses) and not single:
        marked = marked.withColumn("__times", changed).withColumn("__chosen", F.when(kinds["matched"] & (F.col("__times") > 1), F.raise_error(F.lit("MERGE: several source rows match one target row")).cast("int")).otherwise(F.col("__chosen")))
    columns = []
    for n in names:
        value = F.col(f"{alias}.{n}")
        for i, c in reversed(list(enumerate(clauses))):
            to = {k.lower(): e for k, e in c.values}
            if c.action == "update" and n.lower() in to:
                value = F.when(F.col("__chosen") == i, F.expr(to[n.lower()])).otherwise(value)
            elif c.action == "insert":
                value = F.when(F.col("__chosen") == i, F.expr(to[n.lower()]) if n.lower() in to else F.lit(None)).otherwise(value)
        columns.append(value.alias(n))
    deletes = [i for i, c in enumerate(clauses) if c.action == "delete"]
    inserts = [i for i, c in enumerate(clauses) if c.action == "insert"]
    stays = (in_target & ~F.col("__chosen").isin(*deletes) if deletes else in_target) | (F.col("__chosen").isin(*inserts) if inserts else F.lit(False))
    # A target row that several source rows match without a change stands once.
    once = marked if single else marked.withColumn("__nth", F.row_number().over(row.orderBy(F.col("__chosen").desc()))).where("__nth = 1")
    change = F.when(F.col("__chosen").isin(*inserts), 2).otherwise(F.lit(0)) if inserts else F.lit(0)
    updates = [i for i, c in enumerate(clauses) if c.action == "update"]
    change = F.when(F.col("__chosen").isin(*updates), 1).otherwise(change) if updates else change
    return once.withColumn("__stays", stays).where("__stays").select(*columns, change.alias(CHANGE))


def _never(target: DataFrame, source: DataFrame, alias: str, source_alias: str) -> DataFrame:
    """The full outer join on FALSE, as an equality that no row meets: Spark then needs no product."""
    t = target.withColumn("__t", F.lit(True)).withColumn("__row", F.monotonically_increasing_id()).withColumn("__never", F.lit(0)).alias(alias)
    s = source.withColumn("__s", F.lit(True)).withColumn("__source_row", F.monotonically_increasing_id()).withColumn("__never", F.col("__source_row") + 1).alias(source_alias)
    return t.join(s, F.col(f"{alias}.__never") == F.col(f"{source_alias}.__never"), "full")
