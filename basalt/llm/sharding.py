"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions.

Each shard owns ``VNODES`` points of a ring of 2 ** 64 places and a key belongs to the next point
clockwise. No shard takes more than its bound: with a slack of 0 the bounds are the even shares, so
counts differ by one at most; with a slack of e they are (1 + e) times the mean, and fewer keys move
when a shard joins. Keys that overflow a full shard continue clockwise to the next that has room.

The walk needs counts only. Keys are counted by cell: the ring is cut after each virtual node's place, so that
a cell belongs to one point whole, and into equal divisions of a few thousand rows. The walk runs over cells in
ring order and gives each cell quotas: its first so many rows go to its own shard, the next to another. Rows are
numbered in ring order too, so finer divisions give every key the same shard. A cell's rows are then numbered by themselves, so neither a
shard nor the whole ring is ever in one task. Quotas are deterministic, so a rerun gives the same shards.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, mark, stored

VNODES = 64
#: Rows of a cell, about: cells grow in number with the table, not in size.
CELL_ROWS = 4096
#: Equal rows that a task spells out at a time.
TWINS = 1 << 16


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard), ascending."""
    return sorted((xxhash.xxh3_64_intdigest(f"{s}/{v}".encode()), s) for s in range(shards) for v in range(vnodes))


def walk(counts: dict[int, int], bits: int, shards: int, slack: float = 0.0) -> list[tuple[int, int, int, int]]:
    """(cell, first row, shard, first slot) for cells with rows, in order. A cell belongs to the point at or after its end.

    Cells are numbered by their ends in units of 2 ** (64 - bits); with 64 bits a cell's number is its last place.
    """
    points = ring(shards)
    places = [p for p, _ in points]
    total = sum(counts.values())
    base, more = divmod(total, shards)
    room = [base + (s < more) for s in range(shards)] if not slack else [int(-(-total * (1 + slack) // shards))] * shards
    taken, plan, over = [0] * shards, [], []
    cells = sorted(counts)

    def give(cell, first, shard, n):
        plan.append((cell, first, shard, taken[shard]))
        taken[shard] += n

    for cell in cells:  # all homes first: a key moves only if its own shard is full
        at = bisect.bisect_left(places, ((cell + 1) << (64 - bits)) - 1) % len(points)
        shard, n = points[at][1], counts[cell]
        here = min(n, room[shard] - taken[shard])
        if here:
            give(cell, 0, shard, here)
        if n > here:
            over.append((cell, here, n - here, at))
    for cell, first, n, at in over:
        while n:
            at = (at + 1) % len(points)
            shard = points[at][1]
            here = min(n, room[shard] - taken[shard])
            if here:
                give(cell, first, shard, here)
                first, n = first + here, n - here
    return sorted(plan)


def _signed(place: int) -> int:
    return place - (1 << 64) if place >> 63 else place


def in_cells(keys: DataFrame, bits: int, shards: int) -> DataFrame:
    """``keys`` and the last place of each one's cell: its next point, or the end of its 2 ** -bits of the ring if that is sooner."""
    near: dict[int, list[int]] = {}
    for p, _ in ring(shards):
        near.setdefault(p >> (64 - bits), []).append(_signed(p))
    points = keys.sparkSession.createDataFrame([(c, sorted(x)) for c, x in near.items()], "division long, points array<long>")
    end = F.col("place").bitwiseOR(F.lit((1 << (64 - bits)) - 1))
    after = F.get(F.filter("points", lambda p: p >= F.col("place")), F.lit(0))  # all of one sign: a division doesn't cross 2 ** 63
    held = keys.withColumn("division", F.shiftrightunsigned("place", 64 - bits)).join(F.broadcast(points), "division", "left")
    return held.withColumn("cell", F.coalesce(after, end)).drop("division", "points")


def ring_shards(docs: DataFrame, shards: int, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text", marks: bool = False) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, law, shard, slot and grown_shard, a row for each row of ``docs``.

    Slots are gapless from 0 in each shard. The law is ``rows`` (slack 0) or ``bounded``. A null text has no
    bytes and the checksum 0; rows without an id are keyed by their texts; repeated rows are counted, not moved,
    and told apart by their numbers. An empty table gives no rows; extra columns are ignored. With ``marks``
    also the row's mark.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    slim = id_text(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[mark().alias("mark")] * marks)
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size", F.lit(11))).otherwise(F.xxhash64("doc_id", F.lit(10)))
    row = ["place", "doc_id", "text_crc32", "size", *["mark"] * marks]
    # Equal rows are one row with their number from here on: a row of which there are a million weighs as one.
    keys = stored(slim.withColumn("place", place).groupBy(*row).agg(F.count("*").alias("n")), "ring-keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    bits = min(20, max(8, (shards * VNODES).bit_length(), (total // CELL_ROWS).bit_length()))
    keys = in_cells(keys, bits, shards)
    counts = {r.cell & (1 << 64) - 1: r.n for r in keys.groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator()}
    plan = spark.createDataFrame([(_signed(cell), *rest) for cell, *rest in walk(counts, 64, shards, slack)] or [(0, 0, 0, 0)], "cell long, first long, shard int, slot0 long")
    quotas = plan.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("first", "shard", "slot0"))).alias("quotas"))
    before = Window.partitionBy("cell").orderBy(*row).rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(keys.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).join(quotas, "cell"), "ring-places")
    # Of rows that are many, each TWINS go to a task of their own.
    many = placed.where(F.col("n") > TWINS).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(TWINS).cast("long")))).repartition("cell", "place", "from")
    each = placed.where(F.col("n") <= TWINS).withColumn("from", F.lit(0).cast("long")).unionByName(many)
    rows = each.withColumn("twin", F.explode(F.sequence("from", F.least(F.col("from") + TWINS, F.col("n")) - 1))).withColumn("nth", F.col("twin") + F.col("before"))
    own = F.element_at(F.filter("quotas", lambda q: q["first"] <= F.col("nth")), -1)
    law = "bounded" if slack else "rows"
    return rows.withColumn("own", own).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("own.shard").alias("shard"), (F.col("own.slot0") + F.col("nth") - F.col("own.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *["mark"] * marks
    )


def moved(counts: dict[int, int], bits: int, shards: int, slack: float) -> float:
    """The share of rows whose shard differs once there is one shard more; exact if cells are cut for the larger ring."""
    total = sum(counts.values())

    def spans(n):
        plan = walk(counts, bits, n, slack)
        out = {}
        for (cell, first, shard, _), after in zip(plan, [*plan[1:], None], strict=True):
            end = after[1] if after and after[0] == cell else counts[cell]
            out.setdefault(cell, []).append((first, end, shard))
        return out

    a, b = spans(shards), spans(shards + 1)
    same = sum(max(0, min(e, y) - max(s, x)) for c in a for s, e, h in a[c] for x, y, g in b[c] if h == g)
    return 1 - same / total if total else 0.0


def write_shards(docs: DataFrame, path: str, shards: int, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write doc_id, text and slot by shard, in slot order within each file; repeated rows have a slot each."""
    placed = ring_shards(docs, shards, slack, id_col, text_col, marks=True).select("mark", "shard", "slot")
    slim = id_text(docs, id_col, text_col)
    texts = slim.withColumn("of", mark()).dropDuplicates(["of"])  # equal rows have one text
    joined = placed.join(texts, placed["mark"] == texts["of"]).select("doc_id", "text", "shard", "slot")
    joined.repartition("shard", F.expr("slot DIV 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
