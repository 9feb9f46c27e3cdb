"""Exact deduplication with a heavy-hitter split, in DataFrame functions alone.

Texts are equal when the same after their white space is deleted; SHA-256 of the rest stands for a text.
A frequent-items sketch (Misra-Gries, at most ``TRACKED`` counters) finds digests that may hold many rows.
Their counts and winners are verified exactly over all rows, by partial aggregates that shuffle a row per
digest and task, and are broadcast (at most a quarter of ``TRACKED`` rows), so that the rows of large groups are settled
where they lie. All other digests go through one ordinary shuffle; what the sketch guarantees bounds their
groups to about a 1,024th of the table.

The row with the most code points stays, then the one of the smallest id (a null id last). A null text is
empty. Each row is a member of its own, repeated rows too; among wholly equal winners one stays. An empty
table gives no rows. Extra columns are ignored, and carried by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, id_text, mark, numbered, restored, stored

#: Counters of the sketch: the bound of what is broadcast.
TRACKED = 4096
#: A digest of fewer rows is no burden to a shuffle.
HEAVY = 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: bool = False) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(text, SPACE + "+", "")
    return id_text(docs, id_col, text_col).select("doc_id", F.char_length(text).cast("long").alias("n_chars"), F.sha2(bare.cast("binary"), 256).alias("text_sha256"), *[mark().alias("mark")] * marks)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: bool = False) -> DataFrame:
    """doc_id, keep_id (the row that stays), group_size, kept, text_sha256, and the row's mark if wanted: a row for each row of ``docs``."""
    rows = stored(digests(docs, id_col, text_col, marks), "digests")  # the texts are read once
    sketch = rows.agg(F.expr(f"approx_top_k(text_sha256, {TRACKED // 4}, {TRACKED})").alias("top"))
    frequent = sketch.select(F.explode("top").alias("t")).where(F.col("t.count") >= HEAVY).select(F.col("t.item").alias("text_sha256"))
    # The order of "who stays" as one comparable value: most code points, then the smallest id, null last.
    rank = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    heavy = rows.join(F.broadcast(frequent), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.min(rank).alias("best"), F.count("*").alias("group_size"))
    heavy = stored(heavy.select("text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size", "best"), "heavy")

    bounded = F.broadcast(heavy)
    last = ["mark"] * marks
    one = rows.join(bounded, "text_sha256").withColumn("first", rank == F.col("best"))
    # Rows that equal the winner in id and length too: only one of them stays.
    twins = Window.partitionBy("text_sha256", "doc_id").orderBy(*(last or [F.lit(1)]))
    winners = one.where("first").withColumn("kept", F.row_number().over(twins) == 1)
    settled = one.where("NOT first").withColumn("kept", F.lit(False)).unionByName(winners)
    group = Window.partitionBy("text_sha256")
    ordered = group.orderBy(F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last(), *last)
    light = rows.join(bounded, "text_sha256", "left_anti").select(
        "doc_id",
        F.first("doc_id").over(ordered).alias("keep_id"),
        F.count("*").over(group).alias("group_size"),
        (F.row_number().over(ordered) == 1).alias("kept"),
        "text_sha256",
        *last,
    )
    return light.unionByName(settled.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *last))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each group, whatever rows share its id."""
    stays = duplicates(docs, id_col, text_col, marks=True).where("kept").select("mark")
    # Twins are thinned before the join, and so before their texts are shuffled.
    once = numbered(docs, mark(id_col, text_col)).where("row_nth = 1")
    return restored(once.join(stays, once["row_mark"] == stays["mark"]), docs)
