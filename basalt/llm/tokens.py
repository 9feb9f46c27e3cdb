"""Encoding with the ``tokenizers`` library, each distinct word of a block of texts once.

Both vocabularies used here cut a text before each blank that follows a visible character, so a text's
ids are those of its blank-separated chunks one after the other. A block of texts is split in Arrow and
its words are numbered by a dictionary; only distinct words are looked up in a cache, only words not met
lately go through the library, and numpy lays the ids of all texts end to end. The cache is bounded, and
what it forgets is encoded again.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space followed by a blank: such a text isn't cut at every blank.
RUNS = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
#: The same, or a blank at the end, for Arrow.
UNEVEN = "[" + "".join(f"\\x{{{ord(r[0]):x}}}" for r in RUNS) + "] | \\z"
#: Bytes of text in a block; a longer text is a block of its own.
TEXTS = 1 << 22
_ENCODERS: dict[str, Encoder] = {}


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in for each byte in byte-level vocabularies: itself where visible, else 256 upwards."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


_PACK = [struct.Struct(f"<{n}I").pack for n in range(65)]


def packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) <= 64 else np.asarray(ids, "<u4").tobytes()


class Encoder:
    """ids of a text as bytes, little-endian unsigned 32-bit; ``path`` is a file of the tokenizers library.

    ``room`` bounds each of the two generations of cached words, about 200 bytes a word; ``block`` is the bytes of
    text in a block. More of either is fewer words encoded again.
    """

    def __init__(self, path: str, room: int = 300_000, block: int = TEXTS):
        import regex
        from tokenizers import Tokenizer

        self.library, self.room, self.block = Tokenizer.from_file(path), room, block
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = bool(spec["normalizer"])
        rules = spec["pre_tokenizer"].get("pretokenizers", [])
        split = next((p["pattern"]["Regex"] for p in rules if p["type"] == "Split"), None)
        self.blank = "" if self.lower else " "
        self.pieces = regex.compile(split or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.alphabet, self.model = byte_alphabet(), self.library.model
        self.lead = self.blank.translate(self.alphabet)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.piece: dict[str, bytes] = {}
        self.plain = re.compile(r"[\x00-\x1b\x20-\x84\x86-ɏ]*").fullmatch
        self.cuts = re.compile(r"(?<=\S)(?= )").split

    def _library(self, text: str) -> bytes:
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def _model(self, piece: str) -> bytes:
        return packed([t.id for t in self.model.tokenize(piece)])

    def _piece(self, piece: str) -> bytes:
        """A piece as the pre-tokenizer cuts it; those that no word leads off have a small cache of their own."""
        got = self.piece.get(piece)
        if got is None:
            got = self._model(piece.encode().decode("latin-1").translate(self.alphabet))
            if len(self.piece) >= self.room // 8:
                self.piece.clear()
            if len(piece) <= 64:
                self.piece[piece] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        """Plain Latin text has the same letters in every Unicode version; the library's model gets its pieces."""
        if len(chunk) > 200 or not (chunk.isascii() or self.plain(chunk)):
            return self._library(chunk)
        chunk = chunk.lower() if self.lower else chunk
        if chunk[len(self.blank) :].isalpha() and chunk.startswith(self.blank):
            return self._model(chunk.encode().decode("latin-1").translate(self.alphabet))
        return b"".join(map(self._piece, self.pieces(chunk)))

    def _words(self, words: list[str]) -> list[bytes]:
        """ids of words, each with its blank before it."""
        found = list(map(self.new.get, words))
        if None not in found:
            return found
        new, old, blank, lead, lower = self.new, self.old.get, self.blank, self.lead, self.lower
        for k, got in enumerate(found):
            if got is not None:
                continue
            word = words[k]
            got = new.get(word) or old(word)
            if got is None:
                body = word.rstrip(".,;:!?")
                if body and len(word) <= 64 and body.isascii() and body.isalpha():  # letters, then marks: two pieces
                    got = new.get(body) or old(body) or self._model(lead + (body.lower() if lower else body))
                    if len(body) < len(word):
                        new[body] = got
                        got += self._piece(word[len(body) :])
                else:
                    got = self._chunk(blank + word)
            if len(word) <= 64:
                new[word] = got
            found[k] = got
        if len(new) >= self.room:
            self.old, self.new = new, {}
        return found

    def encode(self, text: str) -> bytes:
        parts = text.split(" ")
        if self.lower:
            return b"".join(self._words(parts))
        if any(map(text.__contains__, RUNS)) or text[-1:] == " ":
            return b"".join(map(self._chunk, self.cuts(text)))
        head = self._chunk(parts[0]) if parts[0] else b""
        return head + b"".join(self._words(parts[1:]))

    def blocks(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of some rows on end, their ends by row): each text's ids and the end id; a null text is empty."""
        sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
        row = 0
        while row < len(texts):
            before = int(sizes[row - 1]) if row else 0
            stop = max(row + 1, int(np.searchsorted(sizes, before + self.block, "right")))
            yield row, *self._block(texts.slice(row, stop - row).cast(pa.large_string()).fill_null(""), end_id)
            row = stop
            pa.default_memory_pool().release_unused()

    def _block(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        n, heads = len(texts), []
        if not self.lower:  # a text's first word has no blank before it; an uneven text is encoded whole
            uneven = pc.match_substring_regex(texts, UNEVEN)
            heads = [self.encode(t.as_py()) if u else None for t, u in zip(texts, uneven.to_pylist(), strict=True)] if pc.any(uneven).as_py() else [None] * n
            texts = pc.if_else(uneven, pa.scalar("", texts.type), texts)
        split = pc.split_pattern(texts, " ")
        first = np.asarray(split.offsets)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        code = words.indices.to_numpy()
        found = [*self._words(distinct), packed([end_id])]
        starts = first[:-1] - first[0]
        code = np.insert(code, np.append(starts[1:], len(code)), len(distinct))
        starts = starts + np.arange(n)
        if heads:
            found += [self._chunk(distinct[c]) if h is None and distinct[c] else h or b"" for h, c in zip(heads, code[starts].tolist(), strict=True)]
            code[starts] = np.arange(len(distinct) + 1, len(found))
        length = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        place = np.cumsum(length) - length
        times = length[code]
        ends = np.cumsum(times)
        small = np.int32 if ends[-1] < 1 << 30 and place[-1] < 1 << 30 else np.int64
        at = np.repeat((place[code] - ends + times).astype(small), times)
        at += np.arange(len(at), dtype=small)
        return np.frombuffer(b"".join(found), "<u4")[at], ends[np.append(starts[1:], len(code)) - 1]


def encoder(path: str, **sizes: int) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, **sizes)
    return _ENCODERS[path]
