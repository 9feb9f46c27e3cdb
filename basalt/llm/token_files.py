"""Token files: a corpus as compressed token ids, in ascending order of doc_id.

``write`` range-partitions the documents by id, so that shards follow one another, and writes a Parquet
table of segments: shard, segment, n_docs, n_tokens, index (ids and lengths of its documents) and body
(see ``rans``: one frequency table shared by independent, interleaved, checksummed blocks). Segments end
at the first document that takes them past ``SEGMENT`` ids; a task never holds more than one, whatever
the size of its shard. ``read`` decodes segments in parallel, each by itself.

Null ids come first; rows of the same id stand in the order of their texts; a null text is empty and
gives its end id alone. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import id_text, map_batches
from .tokens import encoder

SEGMENT = 1 << 21
#: A document of a segment: its id, whether that is null, its number of ids.
INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i8")])
SEGMENTS = "shard int, segment int, n_docs long, n_tokens long, index binary, body binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = id_text(docs, id_col, text_col).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        enc, shard = encoder(tokenizer, room=500_000, block=1 << 23), TaskContext.get().partitionId()
        ids, held, counts, segment = [], [], [], 0

        def flush():
            nonlocal ids, held, counts, segment
            n = np.concatenate(counts)
            index = np.array([(i or 0, i is None, k) for i, k in zip(ids, n.tolist(), strict=True)], INDEX)
            out = {"shard": [shard], "segment": [segment], "n_docs": [len(ids)], "n_tokens": [int(n.sum())], "index": [zlib.compress(index.tobytes(), 1)], "body": [rans.encode(np.concatenate(held))]}
            ids, held, counts, segment = [], [], [], segment + 1
            return out

        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, block, ends in enc.blocks(batch.column(1), end_id):
                # Segments end with the first document that takes them past SEGMENT ids.
                first, before = 0, 0
                while first < len(ends):
                    room = SEGMENT - sum(map(len, held))
                    last = min(int(np.searchsorted(ends, before + room)) + 1, len(ends))
                    ids += names[row + first : row + last]
                    held.append(block[before : ends[last - 1]])
                    counts.append(np.diff(ends[first:last], prepend=before))
                    full = int(ends[last - 1]) - before >= room
                    first, before = last, int(ends[last - 1])
                    if full:
                        yield flush()
        if ids:
            yield flush()

    map_batches(placed, run, SEGMENTS).write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; ``with_ids`` adds them."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    schema = "shard int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard, segment, _, n_tokens, index, body = (batch.column(i)[k].as_py() for i in range(6))
                own = np.frombuffer(zlib.decompress(index), INDEX)
                ids = rans.decode(body).astype("<u4")
                if len(ids) != n_tokens:
                    raise ValueError(f"shard {shard}, segment {segment}: {len(ids)} of {n_tokens} ids")
                ends = np.cumsum(own["n"])
                raw = memoryview(ids.tobytes())
                spans = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), own["n"].tolist(), strict=True)]
                out = {
                    "shard": np.full(len(own), shard, np.int32),
                    "segment": np.full(len(own), segment, np.int32),
                    "doc_id": [None if z else i for i, z in zip(own["id"].tolist(), own["null"].tolist(), strict=True)],
                    "within": ends - own["n"],
                    "n_tokens": own["n"],
                    "ids_crc32": [zlib.crc32(s) for s in spans],
                }
                yield out | {"ids": [bytes(s) for s in spans]} if with_ids else out

    return map_batches(segments, run, schema).join(starts_of(segments), ["shard", "segment"]).select("doc_id", (F.col("segment_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def starts_of(segments: DataFrame) -> DataFrame:
    """shard, segment, segment_start. Only sizes are read: in each shard a window, over shards a row per shard."""
    sizes = segments.select("shard", "segment", "n_tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before.orderBy("shard")), F.lit(0)).alias("shard_start"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("shard", "segment", inside.alias("inside")).join(shards, "shard").select("shard", "segment", (F.col("inside") + F.col("shard_start")).alias("segment_start"))


def read_span(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """start, ids: the corpus's ids from ``first`` to before ``last``, a row per segment they lie in.

    Other segments aren't read, and of these only the blocks that hold the span are decoded, from their checkpoints.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    hit = starts_of(segments).where((F.col("segment_start") < last))
    held = segments.join(hit, ["shard", "segment"]).where(F.col("segment_start") + F.col("n_tokens") > first).select("segment_start", "n_tokens", "body")

    def run(batches):
        for batch in batches:
            for start, n, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = max(first - start, 0), min(last - start, n)
                block = rans.block_size(body)
                ids = rans.decode(body, a // block, -(-b // block)).astype("<u4")
                yield {"start": [start + a], "ids": [ids[a % block : a % block + b - a].tobytes()]}

    return map_batches(held, run, "start long, ids binary")
