"""Shared plumbing of the training-data operators: scratch tables, Arrow mapping, fixed-size bitmaps."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pattern of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
#: Pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a task sends to the JVM at a time.
SENT = 1 << 16

_scratch: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every node sees, from ``spark.checkpoint.dir``; where that is unset on a local master (tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that every node sees")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="basalt-"))
        found = _own[0]
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/basalt/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._basalt_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing that is still to run reads it."""
    _delete(df.sparkSession, df._basalt_path)
    _scratch[:] = [x for x in _scratch if x[1] != df._basalt_path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Delete every scratch table of this driver."""
    while _scratch:
        try:
            _delete(*_scratch.pop())
        except Exception:  # the gateway may already be gone at interpreter exit
            continue


atexit.register(release)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: extra columns of any name can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def mark(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What a row's verdict is carried by: its id and the SHA-256 of its text, never null. Only wholly equal ids and texts share one."""
    digest = F.sha2(F.col(text_col).cast("string").cast("binary"), 256)
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-")), F.coalesce(digest, F.lit("-")))


def numbered(docs: DataFrame, marks: Column) -> DataFrame:
    """The columns of ``docs`` as row_0, row_1, .. (so that no name clashes), row_mark and row_nth, a number from 1
    among the rows of a mark, ordered by their other columns. ``restored`` gives the names back."""
    rows = docs.select(*[docs[c].alias(f"row_{k}") for k, c in enumerate(docs.columns)], marks.alias("row_mark"))
    rest = [f"row_{k}" for k, f in enumerate(docs.schema) if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return rows.withColumn("row_nth", F.row_number().over(Window.partitionBy("row_mark").orderBy(*rest)))


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``numbered``, or of a join with it, as rows of ``docs``."""
    return rows.select(*[F.col(f"row_{k}").alias(c) for k, c in enumerate(docs.columns)])


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that yield columns as a dict of arrays or lists, in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches):
        out = to_arrow_schema(target)
        for cols in fn(batches):
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(cols.values(), out, strict=True)]
            made = pa.RecordBatch.from_arrays(arrays, schema=out)
            for at in range(0, max(1, made.num_rows), SENT):  # small batches: the JVM holds one at a time
                yield made.slice(at, SENT)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """(id, UTF-8 bytes) of each row; a null text is empty."""
    ids, text = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
    for k in range(0, len(ids), 256):  # few Python objects at a time
        for i, t in zip(ids[k : k + 256], text.slice(k, 256).to_pylist(), strict=True):
            yield i, t or b""


class Bitmap:
    """A hash set of fixed size without false negatives; it only saves work, an exact step follows."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits, self.cells = bits, np.frombuffer(data, np.uint8) if data else np.zeros(1 << (bits - 3), np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.cells[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(hashes: DataFrame, bits: int, least: int = 1) -> Bitmap:
    return bitmaps_of(hashes, [(bits, least)])[0]


def bitmaps_of(hashes: DataFrame, wanted: list[tuple[int, int]]) -> list[Bitmap]:
    """For each (bits, least) a bitmap of the values of the first column (64-bit hashes, even in their upper
    bits) whose counts (second column) reach ``least`` in total.

    Every slice of a bitmap is built by the task that got its range of hashes, so the driver gets
    2 ** (bits - 3) bytes, whatever the size of the input.
    """
    name, count = hashes.columns[:2]
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = min(16, max(8, parts.bit_length() + 2))  # 2 ** fine slices: a few for each task of a shuffle
    dealt = hashes.withColumn("slice", F.shiftrightunsigned(name, 64 - fine).cast("int"))

    def build(batches):
        held = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        h, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]).astype(np.int64)
        order = np.argsort(h)
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, c = h[first], np.add.reduceat(c, first)
        for k, (bits, least) in enumerate(wanted):
            at, width = np.unique(h[c >= least] >> np.uint64(64 - bits)).astype(np.int64), bits - fine
            slices, first = np.unique(at >> width, return_index=True)
            step = max(1, (1 << 24) >> width)  # 16 million cells at a time
            for j in range(0, len(slices), step):
                some = slices[j : j + step]
                own = at[first[j] : first[j + step] if j + step < len(slices) else len(at)]
                cells = np.zeros((len(some), 1 << width), bool)
                cells[np.searchsorted(some, own >> width), own & ((1 << width) - 1)] = True
                packed = np.packbits(cells, axis=1, bitorder="little")
                yield {"k": np.full(len(some), k, np.int32), "slice": some.astype(np.int32), "cells": [x.tobytes() for x in packed]}

    made = map_batches(dealt.repartition(parts, "slice").select(name, count), build, "k int, slice int, cells binary")
    out = [np.zeros(1 << (bits - 3), np.uint8) for bits, _ in wanted]
    for row in made.toLocalIterator(prefetchPartitions=True):
        each = 1 << (wanted[row.k][0] - fine - 3)
        out[row.k][row.slice * each : (row.slice + 1) * each] = np.frombuffer(row.cells, np.uint8)
    return [Bitmap(bits, cells.tobytes()) for (bits, _), cells in zip(wanted, out, strict=True)]
