"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles (64-bit hashes). Texts of equal sets form a class and
only classes are joined. Shingles fall into classes of frequency: unique, rare (met less than ``FREQUENT``
times) and frequent, and are ordered so, then by hash. Each set indexes a prefix of that order: unique
shingles not at all (nobody shares them), rare ones singly, frequent ones only in pairs. To keep the pairs
few, frequent shingles are dealt by hash into bins and pair up inside a bin.

Why nothing is lost: a set of n shingles may miss n - ceil(t n) of them in a partner. The prefix is
extended until (unique and rare shingles) + (frequent shingles beyond the first of each bin) exceeds that
number, so any partner shares a rare shingle or two frequent ones of a bin that lie in the shorter prefix,
and hence in both. Bins depend on the size's power of two; a set indexes every power its partners can have.

Frequencies are found in two steps. First a quarter of the hash space is counted over all documents; a set
with more unique shingles there than it may miss has no partner and is done. Of the sets that are left the
other shingles are counted too. The counts are bitmaps of fixed size: a shingle that one takes for more
frequent than it is, is so for every document, which costs work and loses nothing.

In a key's bucket every member is first verified against one pivot, the member with the fewest unique
shingles (the text that others were copied from), which settles most groups with a candidate per member.
Buckets whose members then belong to different components are compared across components: small ones pair
by pair; the members of large ones form families, whose sets meet in blocks of bounded size that return at
most a link per member. So every link between components is found. Comparison is of the whole sets.

No pair shares more than the shingles that either has with anybody, so sets and pairs whose unique shingles rule
a link out leave a bucket before any set is sent: pages of one template with words of their own cost a row each.

A null or empty text has no shingles, links with nothing and is its own component; a text with fewer words
than a shingle is one shingle. Rows that share an id share its component if either links. Null ids count
in no minimum. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, bitmaps_of, id_text, map_batches, mark, stored, texts_of
from .graph import connected
from .hashing import mix, signed, windows, word_hashes

#: A shingle met so often is frequent.
FREQUENT = 16
#: Shingles below this hash are counted over all documents: more than a prefix needs, so that most sets are done.
COUNTED = np.uint64(1 << 62)
#: Shingles counted at a time by a task.
CHUNK = 1 << 22
#: Bits of a bitmap for a session of one shuffle partition; a session for more data has more of both.
LEAST_BITS, MOST_BITS = 18, 30
#: Members of a bucket that are paired one by one; sets in a block.
SMALL, BLOCK = 24, 512
#: From sets of 2 ** 4 shingles on, frequent shingles pair up; smaller sets index them singly.
PAIRS_FROM = 4
U = np.uint64


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z lowered, words parted by ASCII white space."""
    h = word_hashes(text.lower().split())
    return np.unique(windows(h, min(width, len(h)))) if len(h) else h


def digest(own: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(own.tobytes())
    return d & (1 << 64) - 1, d >> 64


def longs(values) -> pa.Array:
    return pa.array(signed(np.asarray(values, U)))


def wanted(docs: DataFrame) -> list[tuple[int, int]]:
    """(bits, least count) of the bitmaps: of fixed size whatever the rows, at most 2 ** 27 bytes."""
    bits = min(MOST_BITS, LEAST_BITS + int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length())
    return [(bits, 2), (bits - 2, FREQUENT)]


def counted(batches, read) -> Iterator[dict]:
    """(hash, times) of the shingles that ``read`` takes from batches; CHUNK of them at a time."""
    held, size = [], 0

    def counts():
        got, n = np.unique(np.concatenate(held), return_counts=True)
        return {"h": signed(mix(got)), "n": np.minimum(n, FREQUENT).astype(np.int32)}

    for batch in batches:
        for own in read(batch):
            held.append(own)
            size += len(own)
            if size >= CHUNK:
                yield counts()
                held, size = [], 0
    if size:
        yield counts()


class Seen:
    """Classes that a task has met; forgetting only repeats rows."""

    def __init__(self):
        self.classes: set[int] = set()

    def first(self, cls: int) -> bool:
        new = cls not in self.classes
        if new and len(self.classes) < 1 << 20:
            self.classes.add(cls)
        return new


class Classes:
    """The frequency class of a shingle, from bitmaps of the counted part and of the rest (or None: all frequent)."""

    def __init__(self, low: tuple[Bitmap, Bitmap], high: tuple[Bitmap, Bitmap] | None = None):
        self.low, self.high = low, high

    def sent(self, spark):
        return spark.sparkContext.broadcast([[(b.bits, b.cells.tobytes()) for b in pair] for pair in (self.low, self.high) if pair])

    @staticmethod
    def got(value) -> Classes:
        return Classes(*[tuple(Bitmap(*b) for b in pair) for pair in value])

    def part(self, own: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """(number of unique shingles, the rare, the frequent)."""
        at = int(np.searchsorted(own, COUNTED))
        rare, often, unique = [], [], 0
        for some, bitmaps in ((own[:at], self.low), (own[at:], self.high)):
            if bitmaps is None:
                often.append(some)
                continue
            h = mix(some)
            shared, frequent = (b.has(h) for b in bitmaps)
            unique += int((~shared).sum())
            rare.append(some[shared & ~frequent])
            often.append(some[shared & frequent])
        return unique, np.concatenate(rare), np.concatenate(often)


def low_counts(docs: DataFrame, width: int) -> tuple[Bitmap, Bitmap]:
    """Of the counted part of the hash space: shingles met twice or more, and FREQUENT times or more."""

    def run(batches):
        seen = Seen()

        def read(batch):
            for _, text in texts_of(batch):
                own = shingles(text, width)
                if seen.first(digest(own)[0]):  # copies are one class
                    yield own[: np.searchsorted(own, COUNTED)]

        yield from counted(batches, read)

    return tuple(bitmaps_of(map_batches(docs, run, "h long, n int"), wanted(docs)))


def high_counts(left: DataFrame) -> tuple[Bitmap, Bitmap]:
    """The same of the rest, over the sets (cls, own) that may have partners."""

    def run(batches):
        def read(batch):
            for k in range(batch.num_rows):
                own = np.frombuffer(batch.column(0)[k].as_buffer(), U)
                yield own[np.searchsorted(own, COUNTED) :]

        yield from counted(batches, read)

    return tuple(bitmaps_of(map_batches(left.select("own"), run, "h long, n int"), wanted(left)))


def scanned(docs: DataFrame, width: int, percent: int, sent) -> DataFrame:
    """A row per document (own null): doc_id, cls, n, and what string follows the text; and per class that may have a partner: cls, n, own."""

    def run(batches):
        known, seen = Classes.got(sent.value), Seen()
        for batch in batches:
            rows, size = [], 0
            marks = batch.column(2).to_pylist() if also else [None] * batch.num_rows
            for (doc, text), name in zip(texts_of(batch), marks, strict=True):
                own = shingles(text, width)
                cls, n = digest(own)[0], len(own)
                rows.append((doc, cls, n, None, name))
                if n and seen.first(cls) and known.part(own)[0] <= n - least_overlap(n, percent):
                    rows.append((None, cls, n, own.tobytes(), None))
                    size += n
                if size >= 1 << 20:
                    yield columns(rows)
                    rows, size = [], 0
            yield columns(rows)

    def columns(rows):
        return {"doc_id": [r[0] for r in rows], "cls": longs([r[1] for r in rows]), "n": [r[2] for r in rows], "own": [r[3] for r in rows]} | {c: [r[4] for r in rows] for c in also}

    also = docs.columns[2:]
    return map_batches(docs, run, ", ".join(["doc_id long, cls long, n long, own binary", *[f"{c} string" for c in also]]))


def within(own: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(own), bool)
    at = np.searchsorted(listed, own)
    return listed[np.minimum(at, len(listed) - 1)] == own


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def signatures(own: np.ndarray, classes: Classes, percent: int) -> tuple[np.ndarray, int]:
    """(index keys, number of unique shingles)."""
    n = len(own)
    unique, rare, common = classes.part(own)
    missing = n - least_overlap(n, percent) + 1 - unique
    if missing <= 0:
        return own[:0], unique
    keys = [mix(rare[:missing])]
    missing -= len(rare)
    if missing > 0:
        for level in range(least_overlap(n, percent).bit_length() - 1, (100 * n // percent).bit_length()):
            salt = U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            if level < PAIRS_FROM:
                keys.append(mix(common[:missing] ^ salt))
                continue
            bins = (common >> U(7)) % U((1 << level) // 6)
            _, first = np.unique(bins, return_index=True)
            beyond = np.ones(len(bins), bool)
            beyond[first] = False
            m = int(np.searchsorted(np.cumsum(beyond), missing)) + 1
            by = np.argsort(bins[:m], kind="stable")
            b, s = bins[:m][by], common[:m][by]
            d = 1
            while d < m and (same := b[d:] == b[:-d]).any():
                keys.append(mix((s[:-d][same] * U(0x9E3779B97F4A7C15) + s[d:][same]) ^ salt))
                d += 1
    return np.unique(np.concatenate(keys)), unique


def indexed(left: DataFrame, percent: int, sent) -> DataFrame:
    """key, cls, n, single, common: a row for each index key of each set; ``common`` shingles are not unique."""

    def run(batches):
        known = Classes.got(sent.value)
        for batch in batches:
            out, size = [], 0
            for k in range(batch.num_rows):
                cls, own = batch.column(0)[k].as_py(), np.frombuffer(batch.column(1)[k].as_buffer(), U)
                keys, unique = signatures(own, known, percent)
                out.append((keys, cls, len(own), 1000 * unique // len(own), len(own) - unique))
                size += len(keys)
                if size >= 1 << 18:
                    yield rows(out)
                    out, size = [], 0
            if size:
                yield rows(out)

    def rows(out):
        times = [len(o[0]) for o in out]
        return {"key": longs(np.concatenate([o[0] for o in out]))} | {c: np.repeat(np.array([o[k] for o in out], kind), times) for k, (c, kind) in enumerate((("cls", np.int64), ("n", np.int64), ("single", np.int32), ("common", np.int64)), 1)}

    return map_batches(left.select("cls", "own"), run, "key long, cls long, n long, single int, common long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets meet 100 * common >= percent * union."""
    one = sets.select(F.col("cls").alias("a"), F.col("own").alias("own_a"))
    two = sets.select(F.col("cls").alias("b"), F.col("own").alias("own_b"))

    def run(batches):
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(i)[k].as_buffer(), U) for i in (2, 3))
                common = int(within(x, y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "own_a", "own_b"), run, "a long, b long")


def pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def met(sets: list[np.ndarray], part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different parts, as positions; of links that join the same parts, one."""
    size = np.array([len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int(column.max()) + 1 if len(column) else 0, width):
        some = (column >= at) & (column < at + width)
        m = np.zeros((len(sets), width), np.float32)
        m[row[some], column[some] - at] = 1
        common += m @ m.T  # whole numbers below 2 ** 24: exact
    alike = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    a, b = np.nonzero(np.triu(alike & (part[:, None] != part[None, :]), 1))
    group = {p: p for p in set(part.tolist())}

    def top(p: int) -> int:
        while group[p] != p:
            group[p] = p = group[group[p]]
        return p

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(int(part[i])), top(int(part[j]))
        if p != q:
            group[p] = q
            out.append((i, j))
    return out


def family_links(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across parts among the members (key, cls, part) of large buckets, found in blocks of about 2 * BLOCK sets."""
    first = large.groupBy("key").agg(F.min("cls").alias("b"))
    family = connected(large.select("key", F.col("cls").alias("a")).join(first, "key").select("a", "b").distinct())
    members = large.select("cls", "part").distinct().join(family, F.col("cls") == F.col("node")).select("cls", "part", F.col("label").alias("family"))
    blocks = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(blocks, "family").withColumn("mine", F.pmod(F.xxhash64("cls", F.lit(2)), "blocks").cast("int"))
    # Block x meets block y once: in (least, greatest).
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("family", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "cls", "part")

    def meet(key, table):
        cls = table.column("cls").to_numpy()
        own = [np.frombuffer(x.as_buffer(), U) for x in table.column("own")]
        found = met(own, table.column("part").to_numpy(), percent)
        return pa.table({"a": pa.array([min(cls[i], cls[j]) for i, j in found], pa.int64()), "b": pa.array([max(cls[i], cls[j]) for i, j in found], pa.int64())})

    return sent.join(sets.select("cls", "own"), "cls").groupBy("family", "x", "y").applyInArrow(meet, "a long, b long")


def links(left: DataFrame, percent: int, classes: Classes) -> DataFrame:
    """a, b: verified links between the sets (cls, n, own), enough to connect all that are linked."""
    sent = classes.sent(left.sparkSession)
    members = indexed(left, percent, sent).withColumn("reach", (100 + percent) * F.col("common") - percent * F.col("n"))
    buckets = members.groupBy("key").agg(F.min(F.struct("single", "cls", "n", "reach")).alias("pivot"), F.count("*").alias("members"), F.max("reach").alias("farthest"), F.min("n").alias("least")).where("members > 1")
    # Sets share at most what neither has alone: sets x and y link only if x reaches y's size and y reaches x's.
    able = (F.col("farthest") >= percent * F.col("n")) & (F.col("reach") >= percent * F.col("least"))
    shared = stored(members.join(buckets, "key").where(able).select("key", "cls", "n", "reach", "members", F.col("pivot.cls").alias("pivot"), F.col("pivot.n").alias("pivot_n"), F.col("pivot.reach").alias("pivot_reach")), "shared")
    sent.destroy()

    def alike(x: str, y: str, reach_x: str, reach_y: str):
        sizes = 100 * F.least(x, y) >= percent * F.greatest(x, y)
        return sizes & (F.col(reach_x) >= percent * F.col(y)) & (F.col(reach_y) >= percent * F.col(x))

    tried = stored(shared.where((F.col("cls") != F.col("pivot")) & alike("n", "pivot_n", "reach", "pivot_reach")).select(*pair("cls", "pivot")).distinct(), "tried")
    stars = stored(verified(tried, left, percent), "links")
    labels = connected(stars)
    placed = shared.select("key", "cls", "n", "reach", "members").join(labels, shared["cls"] == labels["node"], "left").select("key", "cls", "n", "reach", "members", F.coalesce("label", "cls").alias("part"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    open_ = stored(placed.join(mixed, "key"), "open")
    one = open_.where(F.col("members") <= SMALL)
    two = one.select("key", F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("part").alias("part2"), F.col("reach").alias("reach2"))
    rest = one.join(two, "key").where((F.col("part") < F.col("part2")) & alike("n", "n2", "reach", "reach2")).select(*pair("cls", "cls2")).distinct()
    rest = rest.join(tried, ["a", "b"], "left_anti")
    large = family_links(open_.where(F.col("members") > SMALL), left, percent)
    return stars.union(stored(verified(rest, left, percent).union(large), "links"))


def components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", marks: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach), class_id: a row for each row of ``docs``.

    With ``marks`` also the row's mark and its part: ids may be null or shared, a part is one component (null without shingles).
    """
    slim = id_text(docs, id_col, text_col)
    low = low_counts(slim, width)
    sent = Classes(low).sent(slim.sparkSession)
    scan = stored(scanned(slim.withColumn("mark", mark()) if marks else slim, width, percent, sent), "scan")
    sent.destroy()
    rows = scan.where("own IS NULL").select("doc_id", "cls", "n", *["mark"] * marks)
    # One row per class: tasks that met the same class each sent its set.
    left = stored(scan.where("own IS NOT NULL").select("cls", "n", "own").dropDuplicates(["cls"]), "sets")
    labels = connected(links(left, percent, Classes(low, high_counts(left))))
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    parts = classes.join(labels, classes["cls"] == labels["node"], "left").select("cls", "first", F.coalesce("label", "cls").alias("part"))
    named = parts.join(parts.groupBy("part").agg(F.min("first").alias("component_id")), "part").select(F.col("cls").alias("of"), "component_id", F.col("first").alias("class_id"), *["part"] * marks)
    full = rows.join(named, (rows["cls"] == named["of"]) & (rows["n"] > 0), "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), *["mark", "part"] * marks)
