"""License scans with a positional index of rare template words.

Templates are the wordings of licences and of the notices that name them. Each word's rarity over the templates
is its inverse document frequency; the index holds, for each template's rarest words, where they stand. A text is
looked up by those words only: every occurrence votes for (template, text position - template position). Votes
whose offsets differ by ``DRIFT`` words at most belong to one place, so that words put in or left out between
them don't matter. Where several words vote, template and text are aligned. A template counts as found if enough
of its words stand there in order, and its mandatory phrase stands in the matched stretch.

Words are runs of ASCII letters and digits (A-Z lowered) and of characters beyond ASCII. Three base
phrases are counted wherever they stand. A null or empty text has no words, no places and the score 0.
Each row is scanned by itself, repeated rows too; an empty table gives no rows; extra columns are ignored.
No shuffle: memory is that of one batch and the index.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from difflib import SequenceMatcher

from pyspark.sql import DataFrame

from .common import id_text, map_batches, texts_of
from .license_texts import TEMPLATES

#: Phrase, label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Rarest words of a template that are indexed: so many, or one in ``EACH`` of its words if that is more.
RARE, EACH = 4, 12
#: How far the offsets of one place may lie apart: words put in or left out.
DRIFT = 12
#: Share of a template's words that must stand in order.
AGREE = 0.7

_SEPARATES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SEPARATES).split()


class Index:
    def __init__(self, templates=TEMPLATES):
        self.templates = [(label, words_of(notice.encode()), phrase.encode().split()) for label, notice, phrase in templates]
        df = Counter(w for _, words, _ in self.templates for w in set(words))
        idf = {w: math.log((1 + len(self.templates)) / n) for w, n in df.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed: list[int] = []
        for t, (_, words, _) in enumerate(self.templates):
            chosen = sorted(set(words), key=lambda w: (-idf[w], w))[: max(RARE, len(words) // EACH)]
            self.needed.append(max(2, len(chosen) // 3))
            for w in chosen:
                self.postings[w] += [(t, i) for i, x in enumerate(words) if x == w]
        self.rare = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, agreement) of each place where a template stands."""
        if self.rare.isdisjoint(words):
            return []
        votes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.rare:
                for t, at in self.postings[w]:
                    votes[t].append((i - at, at))
        found = []
        for t, own in votes.items():
            own.sort()
            done, last = -math.inf, 0
            met: Counter = Counter()  # template positions that vote from offset own[first] on
            for first, (start, at) in enumerate(own):
                while last < len(own) and own[last][0] <= start + DRIFT:
                    met[own[last][1]] += 1
                    last += 1
                if start > done and len(met) >= self.needed[t] and (hit := self._stands(t, words, start, own[first:last])):
                    found.append(hit)
                    done = start + DRIFT
                met[at] -= 1
                if not met[at]:
                    del met[at]
        return found

    def _stands(self, t: int, words: list[bytes], start: int, votes: list[tuple[int, int]]) -> tuple[str, int, int, float] | None:
        label, notice, phrase = self.templates[t]
        a, b = max(0, start), min(len(words), votes[-1][0] + len(notice))
        if not places(words[a:b], phrase):
            return None
        same, where = 0, (a, b)
        for offset, _ in Counter(o for o, _ in votes).most_common(2):  # as it stands, word for word
            agree = sum(0 <= offset + k < len(words) and words[offset + k] == w for k, w in enumerate(notice))
            if agree > same:
                same, where = agree, (max(0, offset), min(len(words), offset + len(notice)))
        if same < len(notice):
            blocks = [x for x in SequenceMatcher(None, notice, words[a:b], autojunk=False).get_matching_blocks() if x.size]
            if sum(x.size for x in blocks) > same:
                same, where = sum(x.size for x in blocks), (a + blocks[0].b, a + blocks[-1].b + blocks[-1].size)
        return (label, *where, same / len(notice)) if same >= AGREE * len(notice) else None


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand one after the other."""
    out, at, k = [], -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + k] == phrase:
                out.append(at)
    except ValueError:
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best agreement), spans."""
    phrases = [(p.encode().split(), label) for p, label in BASE.items()]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long>>"

    def run(batches):
        index = Index()
        for batch in batches:
            rows = []
            for doc, text in texts_of(batch):
                words = words_of(text)
                hits = [(at, label) for phrase, label in phrases for at in places(words, phrase)]
                found = index.scan(words)
                base = {label for _, label in hits}
                starts = [at for at, _ in hits]
                best = max([f[3] for f in found], default=1.0 if hits else 0.0)
                rows.append((doc, len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {f[0] for f in found})), best, [{"label": f[0], "first": f[1], "end": f[2]} for f in sorted(found)]))
            if rows:
                yield dict(enumerate(map(list, zip(*rows, strict=True))))

    return map_batches(id_text(docs, id_col, text_col), run, schema)
