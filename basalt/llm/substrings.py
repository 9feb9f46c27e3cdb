"""Substring deduplication with difference-cover anchors.

The positions of a word sequence that lie in a difference cover (modulo ``PERIOD``) carry an anchor, the
hash of the ``width - PERIOD + 1`` words from there. For any two positions there is a shift below the period
that brings both onto the cover, so two equal windows of ``width`` words, wherever they start, hold an equal
anchor at the same place. Anchors that occur twice mark where windows may repeat; there, and only there,
matches extend to whole windows, which are compared by 128-bit hashes with all others.

1. Tasks report each anchor once with its count; a bitmap of fixed size marks those met twice or more.
2. Windows that hold a marked anchor are grouped by their hash. A task settles windows it meets twice by
   itself and sends one copy on, so a passage that a third of the documents share is a row per task.
3. Repeated windows become word ranges of their rows; only texts with ranges are moved to meet them.

Windows are judged on the input. A null text has no words. Each row is a text of its own: repeated rows
repeat each other's windows. A text of fewer words than a window is kept whole. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, bitmap_of, id_text, map_batches, stored, texts_of
from .hashing import BASES, signed, windows, word_hashes

PERIOD = 21
#: A perfect difference set modulo 21; every residue is a difference of two of these.
COVER = (0, 1, 4, 14, 16)
ANCHOR_BITS, ROW_BITS = 28, 24
#: Windows settled at a time by a task.
CHUNK = 1 << 19
U = np.uint64


def row_key(doc: int | None, text: bytes) -> int:
    """Stands for a row between the scans; rows equal in id and text have the same ranges."""
    return xxhash.xxh3_64_intdigest(text, 0 if doc is None else doc * 2 + 1 & (1 << 64) - 1)


def anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of a word sequence."""
    own = windows(h, width - PERIOD + 1)
    at = np.flatnonzero(np.isin(np.arange(min(PERIOD, len(own))), COVER))
    at = (np.arange(0, len(own), PERIOD)[:, None] + at).ravel() if len(own) else at
    at = at[at < len(own)]
    return at, own[at]


def repeated_anchors(docs: DataFrame, width: int) -> Bitmap:
    def run(batches):
        held, size = [], 0

        def counts():
            nonlocal held, size
            got, n = np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
            return {"h": signed(got), "n": np.minimum(n, 2).astype(np.int32)}

        for batch in batches:
            for _, text in texts_of(batch):
                held.append(anchors(word_hashes(text.split()), width)[1])
                size += len(held[-1])
                if size >= 4 * CHUNK:
                    yield counts()
        if size:
            yield counts()

    return bitmap_of(map_batches(docs, run, "h long, n int"), ANCHOR_BITS, least=2)


def ranges(row: np.ndarray, at: np.ndarray) -> dict:
    """Runs of adjacent window starts, as rows (key, a, b): windows a to b of a text."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1)]) if len(row) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    k = len(first)
    return {"h": signed(row[first]), "h2": pa.nulls(k, pa.int64()), "key": signed(row[first]), "a": at[first], "b": at[last]}


def settle(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by hash, first place of each hash in it, how many)."""
    order = np.lexsort((h2, h))
    a, b = h[order], h2[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
    return order, first, np.diff(np.append(first, len(a)))


def candidates(docs: DataFrame, width: int, marked: Bitmap) -> DataFrame:
    """Rows with h2: a window (h, h2) at word a of row ``key``, b of them in this part of the task. Rows without: settled ranges."""
    sent = docs.sparkSession.sparkContext.broadcast((marked.bits, marked.cells.tobytes()))

    def run(batches):
        bits = Bitmap(*sent.value)
        held, size = [], 0

        def out():
            nonlocal held, size
            h, h2, row, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            order, first, n = settle(h, h2)
            twice = np.repeat(n > 1, n)
            if twice.any():
                yield ranges(row[order][twice], at[order][twice])
            one = order[first]
            yield {"h": signed(h[one]), "h2": signed(h2[one]), "key": signed(row[one]), "a": at[one], "b": n}

        for batch in batches:
            for doc, text in texts_of(batch):
                h = word_hashes(text.split())
                if len(h) < width:
                    continue
                at, own = anchors(h, width)
                at = at[bits.has(own)]
                if not len(at):
                    continue
                # A window from word i holds the anchors of words i to i + PERIOD - 1.
                cover = np.zeros(len(h) + 2, np.int64)
                np.add.at(cover, np.maximum(at - PERIOD + 1, 0), 1)
                np.add.at(cover, at + 1, -1)
                start = np.flatnonzero(np.cumsum(cover)[: len(h) - width + 1])
                held.append((windows(h, width)[start], windows(h, width, BASES[1])[start], np.full(len(start), row_key(doc, text), U), start))
                size += len(start)
                if size >= CHUNK:
                    yield from out()
        if size:
            yield from out()

    return map_batches(docs, run, "h long, h2 long, key long, a long, b long")


def repeated_ranges(found: DataFrame) -> DataFrame:
    """key, spans: the ranges of window starts that repeat, a row for each text that has any.

    Windows arrive sorted by hash, so a task holds a batch and the last window of the batch before.
    """

    def run(batches):
        last = None  # (its row as columns, whether it is known to repeat and was told so)
        for batch in batches:
            settled = batch.filter(batch.column(1).is_null())
            if settled.num_rows:
                yield {"key": settled.column(2), "a": settled.column(3), "b": settled.column(4)}
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows:
                continue
            h, h2, row, at, n = (batch.column(i).to_numpy() for i in range(5))
            told = np.zeros(len(h), bool)
            if last is not None:
                h, h2, row, at, n = (np.concatenate([x, y]) for x, y in zip(last[0], (h, h2, row, at, n), strict=True))
                told = np.concatenate([[last[1]], told])
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
            first = np.flatnonzero(new)
            rows = np.diff(np.append(first, len(h)))
            repeats = np.repeat((rows > 1) | (np.maximum.reduceat(n, first) > 1) | told[first], rows)
            tell = repeats & ~told
            if tell.any():
                got = ranges(row.view(U)[tell], at[tell])
                yield {k: got[k] for k in ("key", "a", "b")}
            last = tuple(x[-1:] for x in (h, h2, row, at, n)), bool(repeats[-1])

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = map_batches(found.repartition(parts, "h").sortWithinPartitions("h", "h2"), run, "key long, a long, b long")
    return made.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of a few rows: what is made of one part is sent before the next."""
    for at in range(0, batch.num_rows, 512):
        yield batch.slice(at, 512)


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (the kept words joined by blanks): a row for each row of ``docs``."""
    if width <= PERIOD:
        raise ValueError(f"a window has more than {PERIOD} words")
    slim = id_text(docs, id_col, text_col)
    spans = stored(repeated_ranges(candidates(slim, width, repeated_anchors(slim, width))), "spans")
    rows = bitmap_of(spans.select("key", F.lit(1).alias("n")), ROW_BITS)
    sent = slim.sparkSession.sparkContext.broadcast((rows.bits, rows.cells.tobytes()))

    def keyed(batches):
        bits = Bitmap(*sent.value)
        for batch in batches:
            for own in slices(batch):
                rows = list(texts_of(own))
                keys = np.array([row_key(doc, text) for doc, text in rows], U)
                yield {"doc_id": own.column(0), "key": pa.array(signed(keys), mask=~bits.has(keys)), "text": own.column(1).fill_null("")}

    def cut(batches):
        for batch in batches:
            for own in slices(batch):
                yield dict(enumerate(map(list, zip(*map(kept_of, texts_of(own), own.column(2).to_pylist()), strict=True))))

    def kept_of(row, spans):
        doc, text = row
        words = kept = text.split()
        if spans:
            edge = np.zeros(len(words) + 1, np.int64)
            for s in spans:
                edge[s["a"]] += 1
                edge[s["b"] + width] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        joined = b" ".join(kept)
        return doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()

    texts = map_batches(slim, keyed, "doc_id long, key long, text string")
    whole = texts.where("key IS NULL").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    moved = texts.where("key IS NOT NULL").join(spans, "key", "left").select("doc_id", "text", "spans")
    return map_batches(whole.union(moved), cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
