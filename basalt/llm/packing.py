"""Packing token sequences into windows by multiway differencing (Karmarkar-Karp).

A document's ids are cut at multiples of the window; whole windows stand alone. What is left of each
document joins a pool as grains of at most ``GRAIN`` ids, and a pool is dealt into windows: every grain
starts as a partial partition of its own, the two partitions of largest imbalance merge, the fullest
windows of one onto the emptiest of the other, until one partition remains. If a window then exceeds
the capacity, the window count rises and the pool is dealt again.

Pools hold a fixed number of grains, so memory and time per document don't depend on the corpus; there
is no shuffle. A task that is run again sees the same rows in the same order and gives the same windows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text, map_batches
from .tokens import encoder

WINDOW = 1024
#: A remainder's grains: small enough that sums can be levelled, large enough to keep text together.
GRAIN = 512
#: Grains dealt at a time.
POOL = 3072
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Deal ``sizes`` into at most ``k`` groups of near-equal sums: each group is a list of positions.

    Merging keeps only groups in use; a partition with fewer than ``k`` has emptiness as its least sum, so its
    imbalance is its largest group. Such a partition takes grains, in descending order, until another
    partition's imbalance is larger than the next grain's; those merges go in one step.
    """
    order = np.argsort(-sizes, kind="stable")
    grains = sizes[order]
    n, at, born = len(order), 0, 0
    # A group is a grain (its position) or, from n on, two groups that met.
    left, right, made = np.zeros(n, np.int64), np.zeros(n, np.int64), n
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # imbalance (negated), age, sums descending, groups

    def push(sums: np.ndarray, groups: np.ndarray) -> None:
        nonlocal born
        by = np.argsort(-sums, kind="stable")
        sums, born = sums[by], born + 1
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), born, sums, groups[by]))

    while at < n or len(heap) > 1:
        if at < n and (not heap or grains[at] >= -heap[0][0]):
            sums, groups = np.empty(0, sizes.dtype), np.empty(0, np.int64)
        else:
            _, _, sums, groups = heapq.heappop(heap)
        other = -heap[0][0] if heap else -1
        if at < n and grains[at] >= other and len(sums) < k:
            stop = at + int(np.searchsorted(-grains[at : at + k - len(sums)], -other, "right"))
            groups = np.concatenate([groups, order[at:stop]])
            sums, at = np.concatenate([sums, grains[at:stop]]), stop
        else:
            if at < n and grains[at] >= other:
                b, b_groups, at = grains[at : at + 1], order[at : at + 1], at + 1
            else:
                _, _, b, b_groups = heapq.heappop(heap)
            if len(sums) < len(b):
                sums, groups, b, b_groups = b, b_groups, sums, groups
            over = max(0, len(sums) + len(b) - k)  # so many of b's fullest go onto the emptiest of the other
            place = len(sums) - 1 - np.arange(over)
            left[made - n : made - n + over], right[made - n : made - n + over] = groups[place], b_groups[:over]
            groups, sums = np.concatenate([groups, b_groups[over:]]), np.concatenate([sums, b[over:]])
            groups[place] = np.arange(made, made + over)
            sums[place] += b[:over]
            made += over
        push(sums, groups)

    def members(group: int) -> list[int]:
        out, todo = [], [group]
        while todo:
            g = todo.pop()
            if g < n:
                out.append(g)
            else:
                todo += (int(right[g - n]), int(left[g - n]))
        return out

    return [members(g) for g in heap[0][3].tolist()] if heap else []


class Dealer:
    """Deals one pool after the other; the room left by the last pool is where the next search begins."""

    def __init__(self, window: int):
        self.window, self.slack = window, 0.002

    def __call__(self, sizes: np.ndarray) -> list[list[int]]:
        least = -(-int(sizes.sum()) // self.window)
        k = max(1, least, int(least * (1 + self.slack * 0.75)))
        while True:
            groups = difference(sizes, k)
            if max(int(sizes[g].sum()) for g in groups) <= self.window:
                if least >= 100:
                    self.slack = k / least - 1
                return groups
            k += max(1, k // 250)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: where its ids stand in the document and in which sequence, at which offset.

    ``with_ids`` adds the piece's ids (binary, little-endian unsigned 32-bit) and ``padded_to``, the
    length to which its sequence is padded: the window, or nothing where the length is a power of two.

    A null or empty text has the end id alone and so gives one piece. Each row is a document of its own,
    repeated rows and null ids too. Other columns are ignored, an empty table gives no rows.
    """

    def run(batches):
        enc, dealer, base = encoder(tokenizer), Dealer(window), TaskContext.get().partitionId() << 36
        made, pool, out = 0, [], []

        def flush():
            nonlocal out
            cols = list(zip(*out, strict=True))
            out = []
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids", "padded_to"] * with_ids
            return {n: pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, cols, strict=True)}

        def add(doc, start, ids, size, offset, total):
            row = (doc, start, len(ids) >> 2, zlib.crc32(ids), size, base + made, offset)
            out.append((*row, ids, total if total & (total - 1) == 0 else window) if with_ids else row)

        def deal():
            nonlocal made, pool
            for group in dealer(np.array([len(p[2]) >> 2 for p in pool], np.int64)) if pool else []:
                offset, total = 0, sum(len(pool[i][2]) >> 2 for i in group)
                for i in sorted(group):
                    add(*pool[i], offset, total)
                    offset += len(pool[i][2]) >> 2
                made += 1
            pool = []

        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, block, ends in enc.blocks(batch.column(1), end_id):
                raw, before = memoryview(block).cast("B"), 0
                for doc, end in zip(names[row : row + len(ends)], ends.tolist(), strict=True):
                    ids, size, before = raw[4 * before : 4 * end], end - before, end
                    whole = size // window * window
                    for start in range(0, whole, window):
                        add(doc, start, bytes(ids[4 * start : 4 * (start + window)]), size, 0, window)
                        made += 1
                    for start in range(whole, size, GRAIN):
                        pool.append((doc, start, bytes(ids[4 * start : 4 * min(start + GRAIN, size)]), size))
                    if len(pool) >= POOL:
                        deal()
                    if len(out) >= 8192:
                        yield flush()
        deal()
        if out:
            yield flush()

    return map_batches(id_text(docs, id_col, text_col), run, SCHEMA + ", ids binary, padded_to long" * with_ids)
