"""The training-data operators against plain Python over whole small tables, planted and real."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import classifier, exact, graph, jaccard, licenses, mixing, packing, queries, rans, rules, sharding, substrings, token_files
from basalt.llm.common import scratch_path
from basalt.llm.tokens import Encoder

from ..conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def planted():
    """Nulls, empties, ties, repeated rows, long and short texts, shared passages, near and exact copies."""
    r = random.Random(5)
    words = ["w%d" % r.randrange(3000) for _ in range(60_000)]

    def prose(n):
        at = r.randrange(len(words) - n)
        return [w + r.choice(["", "", "", ",", "."]) for w in words[at : at + n]]

    out = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n ", "en", "a", 4), (3, "one", "en", None, 3), (4, "One two three　x", None, "b", 5), (None, "null id text " * 20, "de", "b", 1)]
    base = [prose(r.randrange(60, 400)) for _ in range(40)]
    for i in range(300):
        kind, b = r.randrange(6), list(r.choice(base))
        if kind == 0:
            text = " ".join(b)
        elif kind == 1:
            for _ in range(r.randrange(1, 12)):
                b[r.randrange(len(b))] = "edit%d" % r.randrange(99)
            text = "\n".join([" ".join(b[: len(b) // 2]), " ".join(b[len(b) // 2 :])])
        elif kind == 2:
            text = " ".join(prose(r.randrange(5, 200)) + base[0][:50] + prose(r.randrange(5, 200)))
        elif kind == 3:
            text = "\n".join(["the same line again and again"] * r.randrange(2, 40))
        elif kind == 4:
            text = "  ".join(prose(r.randrange(1, 8))) + "\r\n" + "é́ 日本語 ### "
        else:
            text = " ".join(prose(r.randrange(50, 900)))
        out.append((10 + i, text, r.choice(["en", "de"]), r.choice("abcdefg"), len(text)))
    out += [(7, " ".join(words[:20_000]), "en", "a", 1), (10, out[6][1], "en", "a", 1), (10, out[6][1], "en", "a", 1), (11, "another text of a repeated id", "en", "z", 2)]
    out += [(1000 + i, " ".join(base[1]) + " " * i, "en", "hot", 3) for i in range(60)]
    for i in range(60):  # a large group of near copies
        b = list(base[2])
        for _ in range(r.randrange(0, 4)):
            b[r.randrange(len(b))] = "near%d" % r.randrange(9999)
        out.append((2000 + i, " ".join(b), "en", "hot", 3))
    return out


ROWS = planted()


@pytest.fixture(scope="module")
def docs(spark):
    """Also with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    return df.withColumns({"key": F.lit(1), "kept": F.lit("x"), "size": F.lit(2), "slice": F.lit(3), "cls": F.lit(0)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize(("name", "end"), [("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 1)])
def test_encoder_equals_the_library(name, end):
    from tokenizers import Tokenizer

    path = queries.vocabulary(name)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    enc = Encoder(path, room=500)  # small: it forgets
    for text in ["", "  ", " a", "a  b", "a   b\n\n c ", " \n a", "<|endoftext|> x", "it's 'S I'LL", "日本語　全角", "é a", "\x85a \x1c b", "İ ǅ ß", "½ ²", "\ta\t b", "x" * 3000, "a  b", "ﬁ Å"] + [r[1] or "" for r in ROWS]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def ids_of(name, end):
    enc = Encoder(queries.vocabulary(name))
    return [(r[0], np.frombuffer(enc.encode(r[1] or "") + np.array([end], "<u4").tobytes(), "<u4")) for r in ROWS]


def test_packing(docs, none):
    path = queries.vocabulary("byte_bpe_50k.json")
    got = packing.pack(docs, path, with_ids=True).collect()
    by_crc = defaultdict(list)
    for doc, ids in ids_of("byte_bpe_50k.json", 0):
        by_crc[doc].append(ids)
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append((r.start, r.length, np.frombuffer(r.ids, "<u4")))
        sequences[r.sequence_id].append((r.offset, r.length, r.padded_to))
    for doc, all_ids in by_crc.items():
        assert sum(n for _, n, _ in pieces[doc]) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            assert np.concatenate([p for _, _, p in sorted(pieces[doc], key=lambda x: x[0])]).tolist() == all_ids[0].tolist()
    for s in sequences.values():
        at = 0
        for offset, n, _ in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024 and s[0][2] in (at, 1024)
    # Little padding: a few windows beyond the least, for each of the five tasks.
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.01 * total / 1024 + 2 * 5
    assert packing.pack(none, path).count() == 0


def test_difference_levels_groups():
    r = np.random.default_rng(0)
    for n, k in ((1, 1), (5, 9), (400, 37), (3000, 500)):
        sizes = r.integers(1, 257, n)
        groups = packing.difference(sizes, k)
        assert sorted(i for g in groups for i in g) == list(range(n)) and len(groups) <= k
        if n == 3000:
            sums = [sizes[g].sum() for g in groups]
            assert max(sums) - min(sums) < 40
    sizes = np.array([200, 200, 100, 60])
    assert all(sizes[g].sum() <= 256 for g in packing.Dealer(256)(sizes))


def test_jaccard(docs, none):
    for width, percent in ((4, 85), (5, 80)):
        sets = []
        for doc, text, *_ in ROWS:
            w = WORD.findall(lowered(text or ""))
            sets.append((doc, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
        parent = list(range(len(sets)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                x, y = sets[a][1], sets[b][1]
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
        least = {}
        for i, (doc, _) in enumerate(sets):
            if doc is not None:
                least[find(i)] = min(least.get(find(i), doc), doc)
        want = [(doc, len(s), least.get(find(i), doc) if s else doc) for i, (doc, s) in enumerate(sets)]
        got = jaccard.components(docs, width, percent).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted_rows(got) == sorted_rows(want)
    assert jaccard.components(none).count() == 0


def test_signatures_meet_wherever_sets_are_alike():
    """Any two sets over the threshold share an index key, whatever the classes of their shingles."""
    from basalt.llm.common import Bitmap
    from basalt.llm.hashing import mix

    r = np.random.default_rng(1)
    for trial in range(400):
        n = int(r.integers(1, 300))
        x = np.unique(r.integers(0, 2**64 - 1, n, dtype=np.uint64))
        percent = int(r.choice([70, 80, 85, 95]))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.5 + percent / 200], r.integers(0, 2**64 - 1, int(r.integers(0, 1 + len(x) // 12)), dtype=np.uint64)]))
        common = len(np.intersect1d(x, y))
        if not len(y) or 100 * common < percent * (len(x) + len(y) - common):
            continue
        both, shared, frequent = np.intersect1d(x, y), Bitmap(16), Bitmap(12)
        for bitmap, of in ((shared, both), (frequent, both[r.random(len(both)) < r.random()])):
            at = (mix(of) >> np.uint64(64 - bitmap.bits)).astype(np.int64)
            np.bitwise_or.at(bitmap.cells, at >> 3, (1 << (at & 7)).astype(np.uint8))
        classes = jaccard.Classes((shared, frequent), (shared, frequent))
        a, b = (jaccard.signatures(s, classes, percent)[0] for s in (x, y))
        assert len(np.intersect1d(a, b)), trial


def test_blocks_find_links_across_parts():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(120) < 0.97], r.integers(0, 2**63, int(r.integers(0, 15)), dtype=np.uint64)])) for _ in range(60)]
    part = np.arange(60) // 2
    want = {p: p for p in range(30)}

    def top(p):
        while want[p] != p:
            p = want[p]
        return p

    for i in range(60):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                want[top(part[i])] = top(part[j])
    got = {p: p for p in range(30)}
    found = jaccard.met(sets, part, 85)
    for i, j in found:
        a, b = part[i], part[j]
        while got[a] != a:
            a = got[a]
        while got[b] != b:
            b = got[b]
        assert a != b
        got[a] = b

    def root(d, p):
        while d[p] != p:
            p = d[p]
        return p

    assert all((root(got, i) == root(got, j)) == (top(i) == top(j)) for i in range(30) for j in range(30))


def test_jaccard_with_families(docs, monkeypatch):
    """Large buckets by blocks, and everything by pairs: the same components."""
    want = sorted_rows(jaccard.components(docs, 4, 85).select("doc_id", "component_id").collect())
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    assert sorted_rows(jaccard.components(docs, 4, 85).select("doc_id", "component_id").collect()) == want


def test_template_pages_leave_their_buckets(spark, monkeypatch):
    r = random.Random(5)
    base = [f"t{k}" for k in range(400)]

    def page(i):
        at = r.randrange(360)
        return " ".join([*base[:at], *[f"own{i}x{k}" for k in range(40)], *base[at + 40 :]])

    pages = [(i, page(i)) for i in range(150)] + [(900, " ".join(base)), (901, " ".join(base[:395]) + " end")]
    sent = []
    verified, families = jaccard.verified, jaccard.family_links
    monkeypatch.setattr(jaccard, "verified", lambda pairs, sets, percent: (sent.append(pairs.count()), verified(pairs, sets, percent))[1])
    monkeypatch.setattr(jaccard, "family_links", lambda large, sets, percent: (sent.append(large.count()), families(large, sets, percent))[1])
    got = {r.doc_id: r.component_id for r in jaccard.components(spark.createDataFrame(pages, "doc_id long, text string"), 4, 85).collect()}
    shingled = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in pages}
    links = [(i, j) for i in shingled for j in shingled if i < j and 100 * len(shingled[i] & shingled[j]) >= 85 * len(shingled[i] | shingled[j])]
    assert {(i, j) for i, j in links if j < 900} == set() and (900, 901) in links
    assert all((got[i] == got[j]) for i, j in links)
    assert sum(sent) <= 2 * len(pages)  # not a pair for each two pages


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.label for r in graph.connected(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert graph.connected(edges.limit(0)).count() == 0


def test_token_files(spark, docs, none):
    path = queries.vocabulary("word_bpe_49k.json")
    out = scratch_path(spark, "tokens")
    token_files.write(docs, out, path)
    got = token_files.read(spark, out, with_ids=True).orderBy("start").collect()
    order = sorted(zip(ids_of("word_bpe_49k.json", 1), [r[1] for r in ROWS], strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1] is not None, x[1] or ""))
    at = 0
    assert [r.doc_id for r in got] == [x[0][0] for x in order]
    for r, ((_, ids), _) in zip(got, order, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())) and bytes(r.ids) == ids.tobytes()
        at += len(ids)
    empty = scratch_path(spark, "tokens")
    token_files.write(none, empty, path)
    assert token_files.read(spark, empty).count() == 0


def test_a_span_is_read_from_its_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 30_000)
    path = scratch_path(spark, "span")
    token_files.write(docs, path, queries.vocabulary("word_bpe_49k.json"))
    whole = b"".join(r.ids for r in token_files.read(spark, path, with_ids=True).orderBy("start").collect())
    n = len(whole) // 4
    for first, last in ((0, 1), (17, 40_000), (n - 5, n + 9), (n, n + 1), (5, 5), (0, n)):
        got = token_files.read_span(spark, path, first, last).orderBy("start").collect()
        assert b"".join(r.ids for r in got) == whole[4 * first : 4 * max(first, last)]


def test_rans_round_trips_and_notices_damage():
    r = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 16384, 16385, 70_000):
        ids = (r.zipf(1.3, n) % 49_000).astype("<u4")
        assert (rans.decode(rans.encode(ids)) == ids).all()
    data = rans.encode(ids)
    assert (rans.decode(data, 2, 4) == ids[2 * 16384 : 4 * 16384]).all()
    broken = bytearray(data)
    broken[-9] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.decode(bytes(broken))
    with pytest.raises(ValueError):
        rans.decode(b"nothing" * 9)
    assert (rans.decode(rans.encode(np.full(999, 7, "<u4"))) == 7).all()
    ids = ids[: 4 * 16384]  # whole blocks
    p = np.bincount(ids) / len(ids)
    p = p[p > 0]
    bits = 8 * (len(rans.encode(ids)) - 6 * len(p)) / len(ids)  # without the table
    assert bits < 1.03 * -(p * np.log2(p)).sum() + 0.2


def test_rules(docs, none):
    got = sorted_rows(rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = []
    for doc, text, *_ in ROWS:
        text = text or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        seen, covered = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)), set()
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                covered |= {k, k + 1, k + 2}
        want.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == sorted_rows(want)
    judged = rules.judge(docs)
    assert judged.where("kept AND base_failed").count() == 0 and judged.where("kept").count() > 100
    assert rules.judge(none).count() == 0


def test_rules_follow_each_source(spark):
    """What is usual in one source is a fault in another."""
    r = random.Random(1)
    text = lambda mark: " ".join(f"word{r.randrange(10**6)}{mark if r.random() < 0.8 else ''}" for _ in range(80))
    rows = [(i, text("#") if i % 2 else text(""), "en", "tags" if i % 2 else "prose", 0) for i in range(1200)] + [(5000, text("#"), "en", "prose", 0)]
    got = {x.doc_id: x.kept for x in rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got.pop(5000) and all(got.values())


def test_rules_follow_small_sources(spark):
    """A source has thresholds of its own at any size: 30 documents of tags among 900 of prose."""
    r = random.Random(3)
    text = lambda mark: " ".join(f"word{r.randrange(10**6)}{mark if r.random() < 0.8 else ''}" for _ in range(80))
    rows = [(i, text(""), "en", "prose", 0) for i in range(900)] + [(1000 + i, text("#"), "en", "tags", 0) for i in range(30)] + [(5000, text("#"), "en", "prose", 0)]
    got = {x.doc_id: x.kept for x in rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got.pop(5000) and all(got.values())


def test_substrings(docs, none):
    for width in (35, 24):
        words = [WORD.findall(r[1] or "") for r in ROWS]
        count = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
        want = []
        for row, w in zip(ROWS, words, strict=True):
            gone = [False] * len(w)
            for k in range(len(w) - width + 1):
                if count[tuple(w[k : k + width])] > 1:
                    gone[k : k + width] = [True] * width
            kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
            want.append((row[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
        got = substrings.remove_repeats(docs, width)
        assert sorted_rows(got.drop("kept_text").collect()) == sorted_rows(want)
    assert substrings.remove_repeats(none).count() == 0


def test_cover_is_a_difference_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in classifier.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [r for r in labels.where("doc_id % 2 = 1").collect()]
    good = [got[r.doc_id].kept for r in held if r.quality == 1 and r.toxic == 0]
    bad = [got[r.doc_id].kept for r in held if r.quality == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.35
    assert len(got) == docs.count()


def test_classifier_scores_and_top_k(spark, docs, none):
    labels = spark.createDataFrame([(10 + i, i % 2, None if i == 4 else 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = classifier.classify(docs, labels)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    again = {(r.doc_id, r.key): r.kept for r in classifier.classify(docs.repartition(3), labels).collect()}
    assert all(again[r.doc_id, r.key] == r.kept for r in rows)  # reruns agree
    kept = sorted((r.key for r in rows if r.kept), reverse=True)
    assert kept == sorted((r.key for r in rows), reverse=True)[: len(kept)]
    assert classifier.classify(none, labels).count() == 0
    assert classifier.classify(docs, labels.limit(0)).where("NOT kept").count() == 0


def test_importance_is_the_ratio_of_the_models(spark):
    texts = ["aaaa aaaa", "abcd abce", "xyz", "", None, "éü日本"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    n = 1 << classifier.BITS

    def buckets(t):
        b = (t or "").encode()
        return [(int.from_bytes(b[k : k + 4], "little") * 2654435761 & 0xFFFFFFFF) >> (32 - classifier.BITS) for k in range(len(b) - 3)]

    raw, target = Counter(x for t in texts for x in buckets(t)), Counter(buckets(texts[0]))
    ratio = classifier.fit(docs, np.array([0]))
    total = lambda c: sum(c.values()) + n
    want = np.array([np.log((target[b] + 1) / total(target)) - np.log((raw[b] + 1) / total(raw)) for b in range(n)])
    assert np.allclose(ratio, want)
    for r in classifier.score(docs, ratio).collect():
        b = buckets(texts[r.doc_id])
        assert abs(r.importance - (np.mean(want[b]) if b else 0)) < 1e-6


def test_the_draw_follows_the_weights(spark):
    scored = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 6 - 3).cast("double").alias("importance")).cache()
    shares, kept = Counter(), []
    for seed in range(6):
        rows = classifier.draw(scored, 0.8, 0.5, seed).where("kept").collect()
        kept.append(frozenset(r.doc_id for r in rows))
        shares.update(r.importance for r in rows)
    assert len(set(kept)) == 6  # the noise decides
    for x in range(-3, 3):
        assert shares[x] / 6000 == pytest.approx(classifier.taken(np.array(float(x)), 0.8, 0.5), abs=0.03)


def test_the_draw_fits_the_labels():
    r = np.random.default_rng(1)
    x = r.normal(size=8000)
    good = r.random(8000) < classifier.taken(x, 0.3, 0.2)
    t, level = classifier.draw_of(x[good], x[~good])
    assert 0 < t <= classifier.HOTTEST * np.ptp(x[good]) and -1 < level < 0.5
    apart = classifier.draw_of(np.array([1.0, 1.1, 1.2]), np.array([-3.0, -2.0]))
    assert (classifier.taken(np.array([1.0, 1.2]), *apart) > 0.9).all() and (classifier.taken(np.array([-2.0, -3.0]), *apart) < 0.01).all()
    assert classifier.draw_of(np.ones(3), np.ones(2))[1] == 1.0
    assert classifier.draw_of(np.ones(2), np.empty(0)) is None


def test_kth_largest(spark):
    r = np.random.default_rng(3)
    values = np.concatenate([r.normal(size=500), np.full(50, 1.5), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for k in (1, 2, 7, 100, 300, 551):
        assert classifier.kth_largest(df, "v", k) == np.sort(values)[-k]
    assert classifier.kth_largest(df, "v", 0) == float("inf") and classifier.kth_largest(df, "v", 552) == float("-inf")


def test_exact(docs, none, monkeypatch):
    groups = defaultdict(list)
    for doc, text, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc))
    want = []
    for text, members in groups.items():
        first = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        stays = True
        for m in sorted(members, key=lambda m: m != first):
            want.append((m[2], first[2], len(members), stays, hashlib.sha256(text.encode()).hexdigest()))
            stays = False
    for heavy in (64, 2):  # all groups light, or many heavy
        monkeypatch.setattr(exact, "HEAVY", heavy)
        got = exact.duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted_rows(got) == sorted_rows(want)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[3]}
    assert exact.duplicates(none).count() == 0


def test_exact_runs_no_python(docs, spark):
    plan = exact.duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_licenses(spark, none, docs):
    rows = [(1, "x CC  BY cc-by All rights reserved."), (2, "Licensed under the Apache License, Version 2.0."), (3, "the mit of it; released, license"), (4, None), (5, ""), (6, "cc by cc by"), (7, "Permission is hereby granted, free of charge, to ANY person obtaining one copy of this software")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 1, 5, "cc-by,reserved")
    assert got[2].labels == "apache-2.0" and got[2].score == 1.0 and got[2].base_labels == ""
    assert got[3].labels == "" and got[3].score == 0.0
    assert got[4].n_words == got[5].n_words == 0 and got[4].first_word is None
    assert (got[6].n_base, got[6].last_word) == (2, 2)
    assert got[7].labels == "mit" and 0.7 <= got[7].score < 1
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = sorted_rows((r[0], len(words.findall(lowered(r[1] or "")))) for r in ROWS)
    assert sorted_rows(licenses.scan(docs).select("doc_id", "n_words").collect()) == want
    assert licenses.scan(none).count() == 0


def test_license_base_columns_on_planted_rows(spark):
    r = random.Random(9)
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    bits = ["CC", "by", "GENERAL", "public", "License", "all", "rights", "reserved", "cc by", "General Public License", "über", "x1", ",", "-", "日本"]
    rows = [(i, r.choice([" ", "; ", "\n"]).join(r.choice(bits) for _ in range(r.randrange(60)))) for i in range(300)] + [(7, rows_text) for rows_text in ("", None)] + [(r_[0], r_[1]) for r_ in ROWS]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for doc, text in rows:
        w = pattern.findall(lowered(text or ""))
        hits = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        want.append((doc, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted_rows(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == sorted_rows(want)
    for x in got.collect():
        assert set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1
        assert x.labels == ",".join(sorted(set(filter(None, x.labels.split(",")))))


def test_licenses_with_words_put_in_and_left_out():
    index = licenses.Index()
    r = random.Random(2)
    for label, notice, phrase in licenses.TEMPLATES:
        words, key = licenses.words_of(notice.encode()), phrase.encode().split()
        filler = [b"w%d" % r.randrange(10**6) for _ in range(200)]
        whole = filler[:90] + words + filler[90:]
        assert any(f[0] == label and f[1] == 90 and f[3] == 1.0 for f in index.scan(whole)), label
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        if len(words) >= 16:  # three words put in and one left out, not inside the phrase
            spots = [i for i in range(1, len(words)) if not at - 1 <= i <= at + len(key)]
            edited = list(words)
            for i in sorted(r.sample(spots, 3), reverse=True):
                edited.insert(i, b"indeed")
            del edited[-1 if at + len(key) < len(words) else 0]
            hits = [f for f in index.scan(filler[:50] + edited + filler[50:]) if f[0] == label]
            assert any(f[2] - f[1] >= len(words) - 2 and licenses.AGREE <= f[3] < 1 for f in hits), label
    assert index.scan([b"w%d" % i for i in range(500)]) == [] and index.scan([]) == []
    many = index.scan((licenses.words_of(b"Released under the MIT License") + [b"zz"] * 30) * 40)
    assert sum(f[0] == "mit" for f in many) == 40


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    sizes = sorted_rows((r[0], len(WORD.findall(r[1] or ""))) for r in ROWS)
    assert sorted_rows((r.doc_id, r["size"]) for r in got) == sizes
    total = defaultdict(int)
    for _, text, _, source, _ in ROWS:
        total[source] += len(WORD.findall(text or ""))
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        rate = left / sum(weight[s] for s in names if s not in capped)
        aims = {s: 3 * total[s] if s in capped else weight[s] * rate for s in names}
        over = {s for s in names if aims[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - aims[r.source]) < 1e-6 * max(1, aims[r.source]) and r.source_size == total[r.source]
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - aims[s]) <= (mixing.MOST + 1) * mixing.BLOCK, s  # a round's last block is short
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted_rows((r.doc_id, r["size"], r.taken) for r in got) == sorted_rows((r.doc_id, r["size"], r.taken) for r in again)
    assert mixing.mix(none).count() == 0


def test_quotas_are_highest_quotients(spark):
    r = random.Random(7)
    weights = [r.random() ** 3 * 1000 for _ in range(60)] + [0.0, 5000.0]
    seats = Counter()
    for _ in range(777):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    df = spark.createDataFrame([(i, w, 777) for i, w in enumerate(weights)], "i long, w double, n long")
    assert {x.i: x.quota for x in mixing.quotas(df, "w", "n", [], ["i"]).collect()} == {i: seats[i] for i in range(len(weights))}


def test_mixed_documents_hold_the_taken_words(docs):
    unique = docs.where("doc_id >= 12 AND doc_id < 1000 OR doc_id >= 2000")
    plan = {r.doc_id: r.taken for r in mixing.mix(unique).collect()}
    out = defaultdict(int)
    mixed = mixing.mixed_documents(unique)
    assert mixed.columns == unique.columns
    for r in mixed.collect():
        out[r.doc_id] += len(WORD.findall(r.text))
    assert out == {k: v for k, v in plan.items() if v}


def test_mixed_documents_follow_each_rows_plan(shared_ids):
    """Null ids, repeated ids and repeated rows: a row takes its own rounds and span, cut from its own words."""
    docs, rows = shared_ids
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "-")
    want, texts = defaultdict(int), defaultdict(set)
    for r in mixing.mix(docs).collect():
        want[key(r)] += r.taken
    for doc, text, _, source, _ in rows:
        w = WORD.findall(text or "")
        texts[doc is None, doc or 0, source or "-"].add(" ".join(w))
    got = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        w = WORD.findall(r.text)
        got[key(r)] += len(w)
        assert any(" ".join(w) in t for t in texts[key(r)])
    assert got == {k: v for k, v in want.items() if v}


def test_sharding(docs, none):
    got = sharding.ring_shards(docs, 24).collect()
    want = sorted_rows((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert sorted_rows((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and all(0 <= s < 24 for s in slots)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.ring_shards(docs.repartition(3), 24).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in got}
    assert sharding.ring_shards(none, 24).count() == 0


def test_sharding_of_null_ids_and_twins(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TWINS", 64)
    rows = [(None, f"text {i}") for i in range(300)] + [(5, "the same")] * 500 + [(5, "another")] * 3 + [(i, None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "cell", "shard", "slot", "mark", "from", "before")})
    got = sharding.ring_shards(docs, 24).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(slots) == 24 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    path = scratch_path(spark, "shards")
    sharding.write_shards(docs, path, 24)
    back = spark.read.parquet(path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(rows)
    assert {(r.shard, r.slot) for r in back} == {(s, k) for s, own in slots.items() for k in own}


def test_ring_moves_little_and_keeps_its_bounds():
    r = random.Random(2)
    counts = {c: r.randrange(50, 150) for c in range(1 << 12)}
    total = sum(counts.values())
    for slack in (0.0, 0.1, 0.5):
        taken = Counter()
        plan = sharding.walk(counts, 12, 24, slack)
        for (cell, first, shard, slot), after in zip(plan, [*plan[1:], (None,)], strict=True):
            n = (after[1] if after[0] == cell else counts[cell]) - first
            taken[shard] += n
        assert sum(taken.values()) == total and max(taken.values()) <= -(-total * (1 + slack) // 24) + 1
    assert sharding.moved(counts, 12, 24, 0.5) < 0.15 < 1 - 1 / 24
    assert sharding.moved(counts, 12, 24, 0.1) < 0.35


def test_keys_go_to_their_next_point(spark, docs, monkeypatch):
    points = sharding.ring(24)
    # The key of a row without an id is its text's checksum and size.
    text = F.coalesce("text", F.lit(""))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.crc32(text.cast("binary")), (F.octet_length(text) + 8).cast("long"), F.lit(11))).otherwise(F.xxhash64("doc_id", F.lit(10)))
    place = {(r.doc_id, r.crc if r.doc_id is None else 0): r.place & (1 << 64) - 1 for r in docs.select("doc_id", F.crc32(text.cast("binary")).alias("crc"), key.alias("place")).collect()}
    for r in sharding.ring_shards(docs, 24, 23.0).collect():  # room for all rows in any shard
        at = place[r.doc_id, r.text_crc32 if r.doc_id is None else 0]
        assert r.shard == next((s for p, s in points if p >= at), points[0][1])

    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = lambda: sorted_rows(r[:-1] for r in sharding.ring_shards(many, 24).collect())
    coarse = rows()
    monkeypatch.setattr(sharding, "CELL_ROWS", 1)  # cells as fine as in a table of far more rows
    assert rows() == coarse


def test_movement_is_counted_in_rows(spark):
    keys = spark.range(3000).select("id", F.xxhash64("id", F.lit(10)).alias("place"))
    counts = lambda bits: {r.cell & (1 << 64) - 1: r["count"] for r in sharding.in_cells(keys, bits, 25).groupBy("cell").count().collect()}
    owners = [[next((s for p, s in sharding.ring(n) if p >= r.place & (1 << 64) - 1), sharding.ring(n)[0][1]) for r in keys.collect()] for n in (24, 25)]
    assert sharding.moved(counts(8), 64, 24, 24.0) == pytest.approx(np.mean(np.array(owners[0]) != np.array(owners[1])))
    assert sharding.moved(counts(8), 64, 24, 0.0) == pytest.approx(sharding.moved(counts(13), 64, 24, 0.0))


@pytest.fixture(scope="module")
def shared_ids(spark):
    """Planted rows of which a third have a null id, others share ids, and some are delivered thrice."""
    some = [r for k, r in enumerate(ROWS) for _ in range(3 if k % 7 == 0 else 1)]
    rows = [(None if k % 3 == 0 else r[0] // 2 if r[0] is not None and k % 5 == 0 else r[0], *r[1:]) for k, r in enumerate(some)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def named(doc, text):
    """A row's mark, in plain Python."""
    return f"{'-' if doc is None else doc}:{'-' if text is None else hashlib.sha256(text.encode()).hexdigest()}"


def test_quality_stage_decides_by_row(spark, shared_ids):
    import corpus_pipeline as p

    path = scratch_path(spark, "labelled")
    labels = spark.createDataFrame([(10 + i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    want = Counter(r.mark for r in classifier.classify(shared_ids[0], labels, marks=True).where("kept").collect())
    assert 0 < sum(want.values()) < len(shared_ids[1])
    assert Counter(named(r.doc_id, r.text) for r in p.quality(spark, shared_ids[0], path).collect()) == want


def test_exact_stage_keeps_a_row_of_each_group(shared_ids, monkeypatch):
    groups = defaultdict(list)
    for doc, text, *_ in shared_ids[1]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, named(doc, text)))
    want = sorted(min(members)[3] for members in groups.values())
    assert sorted(named(r.doc_id, r.text) for r in exact.drop_copies(shared_ids[0]).collect()) == want
    monkeypatch.setattr(exact, "HEAVY", 2)
    assert sorted(named(r.doc_id, r.text) for r in exact.drop_copies(shared_ids[0]).collect()) == want


def test_near_stage_keeps_a_row_of_each_component(spark, shared_ids):
    import corpus_pipeline as p

    words = [WORD.findall(lowered(r[1] or "")) for r in shared_ids[1]]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    part = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and part[i] != part[j] and 100 * len(a & b) >= 80 * len(a | b):
                part = [part[j] if x == part[i] else x for x in part]
    members, want = defaultdict(list), []
    for (doc, text, *_), own, c in zip(shared_ids[1], sets, part, strict=True):
        if own:
            members[c].append((doc is None, doc or 0, named(doc, text)))
        else:
            want.append(named(doc, text))
    want += [min(m)[2] for m in members.values()]
    got = p.near_copies(spark, shared_ids[0], DATA)
    assert got.columns == shared_ids[0].columns and sorted(named(r.doc_id, r.text) for r in got.collect()) == sorted(want)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    at, seen = docs, []
    for name, stage in p.STAGES[:4]:
        out = stage(spark, at, DATA)
        assert out.columns == docs.columns, name
        path = scratch_path(spark, "stage")
        out.write.parquet(path)
        at = spark.read.parquet(path)
        seen.append(at.collect())
    good = [i for i, x in labels.items() if x.quality == 1 and x.toxic == 0]
    first = {r.doc_id for r in seen[0]}
    assert sum(i in first for i in good) > 0.9 * len(good)
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in seen[1]]
    assert len(texts) == len(set(texts)) and set(texts) == {re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in seen[0]}
    assert {r.doc_id for r in seen[2]} <= {r.doc_id for r in seen[1]}
    words = sum(len(WORD.findall(r.text)) for r in seen[2])
    assert abs(sum(len(WORD.findall(r.text)) for r in seen[3]) - words) < 0.05 * words
    packed = p.STAGES[4][1](spark, at, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in seen[3]}


#: Names that the stages use for columns of their own.
CLASHES = ("row", "row_mark", "row_nth", "mark", "part", "mix_cut", "mix_mark", "taken_mark", "stays_mark", "first", "key", "kept", "cls", "of_source", "shards", "importance", "spot", "size", "n_chars")


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls in any column, repeated rows and ids, a source without words, ties, and extra columns of clashing names."""
    rows = [(None, None, None, None), (None, "", None, "w"), (1, None, "en", "w"), (1, " \n", "en", "w"), (2, "one", "en", None), (2, "one", "en", None), (2, "two words", None, "a")]
    rows += [(9, " ".join(f"w{(k * j) % 97}" for j in range(120)), "en", "ab"[k % 2]) for k in range(1, 20)] + [(None, "x " * 70_000, "de", "b")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(None).cast("long") for c in CLASHES})


@pytest.mark.parametrize("empty", [False, True])
def test_every_stage_on_hostile_rows(spark, hostile, empty):
    import corpus_pipeline as p

    docs = hostile.limit(0) if empty else hostile
    before = {(r.doc_id, r.text, r.source) for r in docs.collect()}
    for name, stage in p.STAGES[:4]:
        own = stage(spark, docs, DATA)
        assert own.columns == docs.columns, name
        got = [(r.doc_id, r.text, r.source) for r in own.collect()]
        assert bool(got) != empty
        if name != "mixing":
            assert set(got) <= before
        else:
            assert {s for _, _, s in got} <= {"a", "b", None}
        if name == "exact dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in got]
            assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in before})
    packed = p.STAGES[4][1](spark, docs, DATA).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in docs.collect())


def test_mixing_of_wordless_sources(spark):
    schema = "doc_id long, text string, source string"
    rows = [(1, "a b c d", "x"), (2, " ", "y"), (3, None, "y"), (4, None, None), (5, "e f", "z")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, schema)).collect()}
    assert {i: r.target for i, r in got.items() if i in (2, 3, 4)} == {2: 0.0, 3: 0.0, 4: 0.0} and sum(r.target for i, r in got.items() if i in (1, 5)) == pytest.approx(6)
    assert all(got[i].taken == 0 for i in (2, 3, 4)) and all(r.taken <= 3 * r.size for r in got.values())
    none = mixing.mix(spark.createDataFrame(rows[1:4], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 3
    assert mixing.mixed_documents(spark.createDataFrame(rows[1:4], schema)).count() == 0


def test_a_full_shards_seats_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 64)
    rows = [(i, "w " * mixing.BLOCK, "a") for i in range(60)] + [(100 + i, "w " * 400, "b") for i in range(40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    small = [r for r in got if r.doc_id < 100]
    assert small[0].target == 3 * small[0].source_size  # the small source is at its bound
    assert sum(r.taken for r in small) == small[0].target  # whole blocks: no seat is lost
    assert all(r.taken <= 3 * r.size for r in got)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", queries.ORACLE)
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, DATA).select(*want.columns)
    assert got.columns == queries.QUERIES[name](spark, DATA).columns
    assert sorted_rows(got.collect()) == sorted_rows(want.fetchall())
