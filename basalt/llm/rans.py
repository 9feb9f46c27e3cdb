"""Static range asymmetric numeral system over token ids, many interleaved lanes at a time.

One segment has one frequency table (16-bit probabilities) for all its blocks. A block is ``BLOCK`` ids
dealt round-robin to ``LANES`` coders whose 16-bit words are interleaved in the order in which a reader
wants them. Each block starts at a checkpoint (its lanes' states and the place of its words), so blocks
decode independently and in parallel, and carries a CRC-32 of its words and states.

Segment layout, little-endian: magic ``TKS1``; uint32 block count, lanes, ids per block, symbol count;
uint64 id count; symbols as uint32; frequencies less 1 as uint16; a checkpoint per block: lanes x uint32
states, uint64 first word, uint32 CRC; then all words as uint16.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, LANES, BLOCK, BITS = b"TKS1", 64, 16384, 16
HEAD = struct.Struct("<4sIIIIQ")
TOTAL = 1 << BITS


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2 ** 16, each at least 1 and below 2 ** 16 where two symbols exist."""
    n = len(counts)
    if n > TOTAL:
        raise ValueError(f"{n} symbols don't fit a table of {TOTAL}")
    f = 1 + np.floor(counts / counts.sum() * (TOTAL - n)).astype(np.int64)
    f[np.argsort(-counts, kind="stable")[: TOTAL - int(f.sum())]] += 1
    f[np.argmax(f)] += TOTAL - int(f.sum())
    return f


def encode(ids: np.ndarray) -> bytes:
    n = len(ids)
    if not n:
        return HEAD.pack(MAGIC, 0, LANES, BLOCK, 0, 0)
    counts = np.bincount(ids)  # ids are below the vocabulary's size
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[symbols] = np.arange(len(symbols))
    at, counts = place[ids], counts[symbols]
    f = quantise(counts)
    start = np.concatenate([[0], np.cumsum(f)[:-1]])
    blocks, steps = -(-n // BLOCK), BLOCK // LANES
    if blocks == 1:
        steps = -(-n // LANES)
    padded = np.full(blocks * steps * LANES, int(np.argmax(f)), np.int32)
    padded[:n] = at
    grid = padded.reshape(blocks, steps, LANES)
    x = np.full((blocks, LANES), TOTAL, np.uint64)
    words, sent = np.zeros((blocks, steps, LANES), np.uint16), np.zeros((blocks, steps, LANES), bool)
    fu, su = f.astype(np.uint64), start.astype(np.uint64)
    for t in range(steps - 1, -1, -1):
        s = grid[:, t]
        freq = fu[s]
        full = x >= freq << np.uint64(16)
        sent[:, t], words[:, t] = full, x & np.uint64(0xFFFF)
        x = np.where(full, x >> np.uint64(16), x)
        q = x // freq
        x = (q << np.uint64(BITS)) + (x - q * freq) + su[s]
    sizes = sent.reshape(blocks, -1).sum(1)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    payload = words[sent].astype("<u2")  # by block, step, lane
    states = x.astype("<u4")
    out = [HEAD.pack(MAGIC, blocks, LANES, steps * LANES, len(symbols), n), symbols.astype("<u4").tobytes(), (f - 1).astype("<u2").tobytes()]
    for b in range(blocks):
        own = states[b].tobytes()
        out += [own, struct.pack("<QI", firsts[b], zlib.crc32(payload[firsts[b] : firsts[b + 1]].tobytes(), zlib.crc32(own)))]
    return b"".join([*out, payload.tobytes()])


def decode(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of the blocks from ``first`` to before ``last``; a checksum that doesn't hold raises ValueError."""
    magic, blocks, lanes, block, n_symbols, n = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.empty(0, np.uint32)
    at = HEAD.size
    symbols = np.frombuffer(data, "<u4", n_symbols, at)
    f = np.frombuffer(data, "<u2", n_symbols, at + 4 * n_symbols).astype(np.uint64) + np.uint64(1)
    at += 6 * n_symbols
    marks = np.frombuffer(data, np.dtype([("x", "<u4", (lanes,)), ("first", "<u8"), ("crc", "<u4")]), blocks, at)
    words = np.frombuffer(data, "<u2", -1, at + marks.nbytes)
    ends = np.append(marks["first"], len(words)).astype(np.int64)
    for b in range(first, last):
        if zlib.crc32(words[ends[b] : ends[b + 1]].tobytes(), zlib.crc32(marks["x"][b].tobytes())) != marks["crc"][b]:
            raise ValueError(f"block {b}: the checksum differs")
    start = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64)
    of_slot = np.repeat(np.arange(n_symbols), f.astype(np.int64))
    x, place = marks["x"][first:last].astype(np.uint64), ends[first:last].copy()
    out = np.empty((last - first, block // lanes, lanes), np.int32)
    words = np.append(words, np.zeros(1, "<u2")).astype(np.uint64)
    for t in range(block // lanes):
        slot = x & np.uint64(TOTAL - 1)
        s = of_slot[slot.astype(np.int64)]
        out[:, t] = s
        x = f[s] * (x >> np.uint64(BITS)) + slot - start[s]
        low = x < TOTAL
        seen = np.cumsum(low, axis=1)
        take = np.where(low, place[:, None] + seen - 1, len(words) - 1)
        x = np.where(low, (x << np.uint64(16)) | words[take], x)
        place += seen[:, -1]
    got = symbols[out.reshape(-1)]
    return got[: max(0, min(n, last * block) - first * block)]


def block_size(data: bytes) -> int:
    """ids per block of a segment."""
    return HEAD.unpack_from(data)[3]
