"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Sources share the corpus's words by weight; a target stops at ``MOST`` times its source, the excess is
shared again. The mix is counted in blocks of ``BLOCK`` words: the divisor rule of Sainte-Laguë (highest
quotients weight / (2 seats + 1)) gives each source an integer quota, and the same rule divides a source's
quota over its shards. In a shard documents stand in seeded order, their words form a ring of blocks, and
the quota is taken from a seeded block onwards: whole rounds repeat the shard, the rest is one arc, so at
most a few documents of a shard are cut. Shards hold about ``SHARD_WORDS`` words, so a source that holds a
third of the corpus has as many shards as it needs.

All in DataFrame functions: quotients are ranked in a window over a few rows per source (or per shard).

A null text has no words; a null source is the last source; rows of one id are documents of their own;
the order is total but for rows equal in id and size, which are alike in the result too. A source without
words has the target 0 and takes nothing; a corpus without words is a mix of nothing, with a row for each
document; an empty table gives no rows. Extra columns, whatever their names, are ignored by ``mix`` and
carried by ``mixed_documents``. A row per source and per shard is ranked in windows: their number, not that
of the documents, bounds what one task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, mark, numbered, stored

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 32
SHARD_WORDS = 1 << 20


def source_mark(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Column:
    """A row's mark with its source, never null."""
    source = F.col(source_col).cast("string")
    return F.concat(mark(id_col, text_col), F.coalesce(F.concat(F.lit("="), source), F.lit("-")))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", marks: bool = False) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), *[source_mark(id_col, text_col, source_col).alias("mark")] * marks)


def targets(totals: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from source, source_size: shares by weight, none above its cap.

    In ascending order of cap / weight the capped sources are a prefix: source k is capped if its fair
    share, once those before it have their caps, reaches its own cap.
    """
    # UTF-8 order is code point order; a null source comes last. A row per source: the windows are small.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    cap = (F.col("source_size") * most).cast("double")
    parties = totals.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights))).withColumn("cap", cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(F.lit(1)), order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = parties.withColumn("rate", left / open_weight).withColumn("capped", F.col("rate") * F.col("weight") >= F.col("cap"))
    rate = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("rate")))).over(every)["rate"]
    return filled.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * rate).alias("target"))


def quotas(parties: DataFrame, weight: str, seats: str, group: list[str], tie: list[str]) -> DataFrame:
    """Adds ``quota``: Sainte-Laguë seats of each row among the rows of its group; ``seats`` is constant in a group.

    Seats s of a row rank by the quotient weight / (2 s + 1). A row's seats differ from its exact share
    by less than its share of the rows' half seats, so it's enough to rank the quotients next to the exact
    share: those more than ``near`` below are won by any rule, those more than ``near`` above by none.
    """
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    share = F.try_divide(F.col(weight).cast("double"), F.sum(F.col(weight).cast("double")).over(every))  # null in a group without weight: nobody wins a seat
    exact = share * F.col(seats)
    # Half a seat a row is what rounding can leave over; a row's part of it is in proportion to its share.
    near = F.ceil(F.count("*").over(every) * share).cast("long") + 2
    held = parties.withColumn("exact", F.coalesce(exact, F.lit(0.0))).withColumn("sure", F.greatest(F.floor("exact").cast("long") - F.coalesce(near, F.lit(0)), F.lit(0).cast("long"))).withColumn("near", F.coalesce(near, F.lit(0).cast("long")))
    left = (F.col(seats) - F.sum("sure").over(every)).alias("left")
    tried = held.select("*", left).select("*", F.explode(F.sequence(F.col("sure"), F.floor("exact").cast("long") + F.col("near"))).alias("seat"))
    quotient = F.col(weight) / (2 * F.col("seat") + 1)
    best = Window.partitionBy(*(group or [F.lit(1)])).orderBy(quotient.desc(), *tie)
    won = tried.where(F.col(weight) > 0).withColumn("place", F.row_number().over(best)).where("place <= left").groupBy(*group, *tie).agg(F.count("*").alias("won"))
    keys = [*group, *tie]
    won = won.withColumnsRenamed({k: f"won_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & held[k].eqNullSafe(won[f"won_{k}"])
    return held.join(won, same, "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0))).drop("exact", "sure", "near", "won", *[f"won_{k}" for k in keys])


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", marks: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, and where: ``rounds`` whole copies, then words [first, first + cut) and [0, wrapped).

    With ``marks`` also the row's mark and nth, its number among the rows of its mark.
    """
    slim = stored(sizes(docs, id_col, text_col, source_col, marks), "sizes")  # the texts are read once
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(totals, weights, most)
    total_blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / BLOCK).cast("long")
    aims = stored(quotas(aims.withColumn("blocks", total_blocks), "target", "blocks", [], ["source"]).drop("blocks").withColumnRenamed("quota", "source_quota").withColumn("shards", F.ceil(F.col("source_size") / SHARD_WORDS).cast("long")), "targets")
    of = aims.withColumnRenamed("source", "of_source")
    placed = slim.join(of, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("spot", F.xxhash64("doc_id", F.lit(seed)))
    placed = placed.withColumn("shard", F.pmod("spot", F.greatest("shards", F.lit(1).cast("long"))))
    parts = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    parts = quotas(parts.withColumn("words_d", F.col("words").cast("double")), "words_d", "source_quota", ["source"], ["shard"])
    in_shard = F.ceil(F.col("words") / BLOCK).cast("long")
    parts = parts.withColumn("n_blocks", in_shard)
    # No shard gives more than ``most`` rounds; seats beyond that go to the source's next shards with room.
    bound, of_one = most * F.col("n_blocks"), Window.partitionBy("source")
    zero = F.lit(0).cast("long")
    room = F.greatest(bound - F.col("quota"), zero)
    parts = parts.withColumn("over", F.sum(F.greatest(F.col("quota") - bound, zero)).over(of_one)).withColumn("room", room)
    before = F.coalesce(F.sum("room").over(of_one.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), zero)
    parts = stored(
        parts.withColumn("quota", F.least("quota", bound) + F.greatest(F.least("room", F.col("over") - before), zero))
        .select(F.col("source").alias("of_source"), F.col("shard").alias("of_shard"), "words", "n_blocks", "quota", F.when(F.col("n_blocks") > 0, F.pmod(F.xxhash64("source", "shard", F.lit(seed)), "n_blocks")).otherwise(F.lit(0)).alias("from_block")),
        "shards",
    )
    stand = Window.partitionBy("source", "shard").orderBy(F.xxhash64("spot", F.lit(seed + 1)), "doc_id", "size", *["mark"] * marks).rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("at", F.coalesce(F.sum("size").over(stand), F.lit(0).cast("long")))
    joined = at.join(parts, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("shard") == F.col("of_shard")))
    joined = joined.withColumn("rounds", F.when(F.col("n_blocks") > 0, F.expr("quota DIV n_blocks")).otherwise(F.lit(0).cast("long"))).withColumn("rest", F.col("quota") - F.col("rounds") * F.col("n_blocks"))
    end = F.col("at") + F.col("size")
    arc_from, arc_to = F.col("from_block") * BLOCK, (F.col("from_block") + F.col("rest")) * BLOCK
    wrap_to = F.greatest(F.col("from_block") + F.col("rest") - F.col("n_blocks"), zero) * BLOCK
    first = F.least(F.greatest(arc_from - F.col("at"), zero), F.col("size"))
    joined = joined.withColumn("first", first).withColumn("cut", F.greatest(F.least(end, arc_to) - F.col("at") - F.col("first"), zero)).withColumn("wrapped", F.greatest(F.least(end, wrap_to) - F.col("at"), zero))
    nth = ["mark", F.row_number().over(Window.partitionBy("mark").orderBy("at")).alias("nth")] if marks else []
    return joined.select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + F.col("cut") + F.col("wrapped")).alias("taken"), "source", "rounds", "first", "cut", "wrapped", *nth)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix has them: a row per whole copy, and one per part with its words joined by blanks.

    All columns of ``docs`` (doc_id, text, ...); each row has its own plan, rows equal in id, text and source in turn.
    """
    plan = mix(docs, marks=True, **options).where("taken > 0").select(*[F.col(c).alias(f"mix_{c}") for c in ("mark", "nth", "rounds", "first", "cut", "wrapped")])
    names = {c: options[c] for c in ("id_col", "text_col", "source_col") if c in options}
    text_col = options.get("text_col", "text")
    joined = numbered(docs, source_mark(**names)).join(plan, (F.col("row_mark") == F.col("mix_mark")) & (F.col("row_nth") == F.col("mix_nth")))
    of = {c: F.col(f"row_{k}") for k, c in enumerate(docs.columns)}
    text = of[text_col]
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    size = F.regexp_count(text, F.lit(WORD))
    span = F.col("mix_cut") + F.col("mix_wrapped")
    # A part that is the whole text, in one piece or as both ends of the ring, is a copy.
    wholes = F.when(span >= size, F.array_repeat(F.lit(None).cast("string"), (F.col("mix_rounds") + 1).cast("int"))).otherwise(
        F.concat(
            F.array_repeat(F.lit(None).cast("string"), F.col("mix_rounds").cast("int")),
            F.when(F.col("mix_cut") > 0, F.array(F.array_join(F.slice(words, (F.col("mix_first") + 1).cast("int"), F.col("mix_cut").cast("int")), " "))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("mix_wrapped") > 0, F.array(F.array_join(F.slice(words, F.lit(1), F.col("mix_wrapped").cast("int")), " "))).otherwise(F.array().cast("array<string>")),
        )
    )
    rows = joined.withColumn("part", F.explode(wholes))
    out = of | {text_col: F.coalesce("part", text)}
    if "n_chars" in of:
        out["n_chars"] = F.when(F.col("part").isNotNull(), F.char_length("part").cast(docs.schema["n_chars"].dataType)).otherwise(of["n_chars"])
    return rows.select(*[c.alias(k) for k, c in out.items()])
