"""Positions in a table's hidden order, as bounds on (generation, ordinal) that reach the files.

An ordinal is a write task's number and a count within it, so that a row for each write task is enough to
place any position. Nothing here sorts more than the rows asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import GENERATION, HIDDEN, ORDINAL

#: An ordinal's lower bits count within a task.
TASK_BITS = 33
Run = tuple[int, int, int]  # first position, generation, task


def runs_of(frame: DataFrame) -> tuple[list[Run], int]:
    """(where each write task's rows begin, how many rows there are); only the hidden columns are read."""
    tasks = frame.groupBy(GENERATION, F.shiftright(ORDINAL, TASK_BITS).alias("task")).agg(F.count("*").alias("n")).orderBy(GENERATION, "task").collect()
    runs, rows = [], 0
    for t in tasks:
        runs.append((rows, t[GENERATION], t.task))
        rows += t.n
    return runs, rows


def between(frame: DataFrame, runs: list[Run], start: int, end: int) -> DataFrame:
    """The rows at positions ``start`` to before ``end``."""
    if start >= end:
        return frame.limit(0)
    gen, order = F.col(GENERATION), F.col(ORDINAL)

    def place(position: int) -> tuple[int, int]:
        first, generation, task = next(r for r in reversed(runs) if r[0] <= position)
        return generation, (task << TASK_BITS) + position - first

    (g1, o1), (g2, o2) = place(start), place(end - 1)
    if g1 == g2:
        return frame.where((gen == g1) & order.between(o1, o2))
    return frame.where(((gen == g1) & (order >= o1)) | ((gen > g1) & (gen < g2)) | ((gen == g2) & (order <= o2)))


def in_order(frame: DataFrame) -> DataFrame:
    return frame.orderBy(*HIDDEN).drop(*HIDDEN)
