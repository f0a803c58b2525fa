"""Alignment, licences and resampling: brute force, odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings as hyp, strategies as st

from corpusgraph.functions.tables import written
from corpusgraph.llm import alignment, licences, resampling, settings
from corpusgraph.llm.plainwords import plain_words
from .conftest import prose

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

CHARS = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t.'’aéÉß▁日🙂 ‍́"))


def split(text):
    return _WORD.findall((text or "").translate(_LOWER))


@given(st.lists(st.one_of(st.none(), st.text(CHARS, max_size=40)), max_size=8))
@hyp(max_examples=200, deadline=None)
def test_plain_words_match_the_pattern(texts):
    w = plain_words(pa.array(texts, pa.string()))
    for n, text in enumerate(texts):
        a, b = w.first[n], w.first[n + 1]
        got = [w.data[w.start[i]:w.start[i + 1] - 1].tobytes().decode() for i in range(a, b)]
        assert got == split(text)
        for i, word in zip(range(a, b), got):
            raw = (text or "").encode()[w.raw[i]:w.raw[i] + len(word.encode())]
            assert raw.decode().translate(_LOWER) == word


# --- resampling

@given(st.lists(st.binary(max_size=70), max_size=30))
@hyp(max_examples=100, deadline=None)
def test_matrix_crcs(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    start = np.append(0, np.cumsum(size))[:-1]
    assert resampling.crcs(data, start, size).tolist() == [zlib.crc32(p) for p in parts]


def test_matrix_crcs_of_long_slices(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(50_000), np.uint8)
    monkeypatch.setattr(resampling, "_MATRIX", 1000)
    start, size = np.array([0, 7, 100, 3]), np.array([49_000, 2500, 2500, 0])
    assert resampling.crcs(data, start, size).tolist() == [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(start, size)]


def brute_resampling(docs, target):
    def runs(text):
        w = split(text)
        return w, [f.encode() for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]
    count = lambda texts: Counter(zlib.crc32(f) % 10000 for t in texts for f in runs(t)[1])
    s, t = count(x for _, x in docs), count(target)
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0)))) for b in range(10000)}
    out = []
    for i, text in docs:
        words, own = runs(text)
        weight = sum(gain[zlib.crc32(f) % 10000] for f in own) // max(1, len(own))
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for n, r in enumerate(able[:len(able) * 25 // 100]):
        r[5] = n + 1
    return sorted(map(tuple, out), key=repr)


def test_resampling_brute_force(spark, table):
    r = random.Random(3)
    docs = [(i, prose(i, r.randint(0, 60))) for i in range(300)] + [(1000 + i, "É-x_Y 9 " * i) for i in range(30)]
    target = [prose(i, 30) for i in range(290, 310)]
    got = resampling.drawn(table(docs), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute_resampling(docs, target)
    assert sum(x.rank is not None for x in got) > 50


def test_resampling_odd_rows(spark, table, odd):
    rows = [(x.doc_id, x.text) for x in odd.collect()]
    target = table([(1, prose(5, 80)), (2, None)])
    assert sorted(map(tuple, resampling.drawn(odd, target).collect()), key=repr) == brute_resampling(rows, [prose(5, 80)])
    assert resampling.drawn(odd, target.limit(0)).count() == len(rows)
    assert resampling.drawn(odd.limit(0), target).count() == 0


# --- licences

def brute_licences(text):
    words = split(text)
    places = {label: [i for i in range(len(words)) if " ".join(words[i:i + phrase.count(" ") + 1]) == phrase]
              for phrase, (label, _) in licences.BASE.items()}
    every = sorted(i for own in places.values() for i in own)
    return (len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, v in places.items() if v)))


def test_licences_brute_force(spark, table):
    r = random.Random(5)
    bits = ["cc", "by", "CC-BY", "general", "General Public\nLicense", "public", "license", "all", "rights", "reserved", "All rights  reserved.", "x", "é", "MIT License,", "nc"]
    docs = [(i, r.choice([" ", "\n", "-"]).join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(400)]
    got = {x.doc_id: x for x in licences.summarised(licences.scanned(table(docs))).collect()}
    for i, text in docs:
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute_licences(text)
        phrases = {label for p, (label, _) in (licences.BASE | licences.NOTICES).items() if f" {p} " in f" {' '.join(split(text))} "}
        assert x.labels == ",".join(sorted(phrases)) and 0 <= x.score <= 1 and (x.score > 0) == bool(phrases)


@pytest.mark.parametrize("text, expression, asked, found", [
    ("(MIT OR Apache-2.0) AND GPL-2.0-or-later WITH Classpath-exception-2.0 */", "( mit or apache-2.0 ) and gpl-2.0-or-later with classpath-exception-2.0", "weak", ["mit", "apache-2.0", "gpl-2.0-or-later"]),
    ("MIT OR GPL-2.0-only AND MPL-2.0", "mit or gpl-2.0-only and mpl-2.0", "permissive", ["mit", "gpl-2.0-only", "mpl-2.0"]),
    ("(MIT OR GPL-2.0-only) AND MPL-2.0", "( mit or gpl-2.0-only ) and mpl-2.0", "weak", ["mit", "gpl-2.0-only", "mpl-2.0"]),
    ("MIT and see the notes", "mit", "permissive", ["mit"]),
    ("GPL-2.0+ OR (MIT", "gpl-2.0+", "strong", ["gpl-2.0+"]),
    ("AGPL-3.0-only) more", "agpl-3.0-only", "strong", ["agpl-3.0-only"]),
    ("LicenseRef-own AND cc-by-nc-4.0", "licenseref-own and cc-by-nc-4.0", "restricted", ["licenseref-own", "cc-by-nc-4.0"]),
    ("(MIT", "", None, []), ("OR MIT", "", None, []), ("words only", "", None, []), ("", "", None, []),
])
def test_expressions(text, expression, asked, found):
    tokens = licences.tokens(text)
    assert " ".join(tokens) == expression and licences.evaluated(tokens) == (asked, found)


ORDERED = {k: n for n, k in enumerate(licences.ORDER)}
TREES = st.recursive(st.sampled_from(["mit", "gpl-2.0-only", "mpl-2.0", "x-1", "cc-by-nc-4.0"]),
                     lambda t: st.tuples(t, st.sampled_from(["and", "or"]), t), max_leaves=12)


@given(TREES)
def test_expressions_mean_what_their_tree_means(tree):
    def write(t):
        return t if isinstance(t, str) else f"({write(t[0])} {t[1]} {write(t[2])})"

    def value(t):
        return ORDERED[licences.terms(t)] if isinstance(t, str) else (min if t[1] == "or" else max)(value(t[0]), value(t[2]))
    assert licences.evaluated(licences.tokens(write(tree)))[0] == licences.ORDER[value(tree)]


def test_deep_expressions():
    deep = "(" * 5000 + "MIT" + " AND ISC)" * 5000
    assert licences.evaluated(licences.tokens(deep))[0] == "permissive"


def test_tags_and_odd_rows(spark, table, odd):
    docs = table([(1, "é // spdx-license-identifier : (MIT OR GPL-3.0-only) see"), (2, "SPDX License Identifier MIT"), (3, 'license_expression = "ISC"')])
    got = {x.doc_id: x for x in licences.summarised(licences.scanned(docs)).collect()}
    assert (got[1].labels, got[1].terms, got[2].labels, got[3].labels) == ("gpl-3.0-only,mit", "permissive", "", "isc")
    (find,) = licences.scanned(docs.where("doc_id = 3")).collect()[0].finds
    assert (find.word, find.n_words, find.expression) == (0, 2, "isc")
    rows = licences.scanned(odd).collect()
    assert sorted((x.doc_id or -1, x.n_words) for x in rows) == sorted((x.doc_id or -1, len(split(x.text))) for x in odd.collect())
    assert all(x.finds == [] and x.score == 0 for x in rows)
    assert licences.scanned(odd.limit(0)).count() == 0


# --- alignment

@pytest.fixture(scope="module")
def both():
    return alignment.Encoders(settings.byte_bpe(), settings.piece_bpe())


def ends(sizes):
    return np.cumsum(sizes) if len(sizes) else np.zeros(0, np.int64)


@given(st.lists(st.tuples(st.lists(st.integers(1, 9), min_size=1, max_size=30), st.randoms()), max_size=6))
@hyp(max_examples=200, deadline=None)
def test_intersection_brute_force(texts):
    sides, firsts = ([], []), ([0], [0])
    for sizes, r in texts:
        total = sum(sizes)
        other = sorted(r.sample(range(1, total + 1), r.randint(0, total - 1)) + [total])
        for s, e in ((0, ends(sizes)), (1, np.unique(other))) if r.random() < 0.5 else ((1, ends(sizes)), (0, np.unique(other))):
            sides[s].append(e)
        for s in (0, 1):
            firsts[s].append(firsts[s][-1] + len(sides[s][-1]))
    join = [np.concatenate([np.zeros(0, np.int64), *s]).astype(np.int64) for s in sides]
    begin, n = alignment.intersected(join, [np.array(f) for f in firsts])
    for t in range(len(texts)):
        a, b = sides[0][t], sides[1][t]
        for i in range(len(a)):
            lo, hi = (a[i - 1] if i else 0), a[i]
            want = [j for j in range(len(b)) if (b[j - 1] if j else 0) < hi and b[j] > lo]
            at = firsts[0][t] + i
            assert begin[at] - firsts[1][t] == want[0] and n[at] == len(want)


@given(st.lists(st.text(CHARS, max_size=60), min_size=1, max_size=4))
@hyp(max_examples=150, deadline=None)
def test_ids_of_parts_are_ids_of_whole_texts(both, texts):
    assert both.by_part
    whole = [both._spelt([t])[0] or [[], []] if t else [[], []] for t in texts]
    ids, counts = both.encode(texts)
    for s in (0, 1):
        assert counts[s].tolist() == [len(w[s]) for w in whole] and ids[s].tolist() == [i for w in whole for i in w[s]]


def brute_alignment(both, rows):
    def cut(ids, words):
        at, out = 0, []
        for i in ids:
            out.append((at, at := at + len(words[i])))
        return out, at
    done = []
    for doc_id, text in rows:
        ids = [side.encode([text])[0] if text else [] for side in both.sides]
        if text and any(b"".join(side.bytes[i] for i in own) != b" " + text.encode() for side, own in zip(both.sides, ids)):
            ids = [[], []]
        spans = [cut(i, side.bytes)[0] for i, side in zip(ids, both.sides)]
        links = [(ids[0][i], ids[1][j]) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if a < d and c < b]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, last = [], 0
        for e in common:
            groups.append("|".join(",".join(str(x) for x, (s, t) in zip(ids[k], spans[k]) if last <= s and t <= e) for k in (0, 1)))
            last = e
        done.append((doc_id, ids, links, groups))
    count = Counter(p for *_, links, _ in done for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    return sorted(((i, len(ids[0]), len(ids[1]), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, ids, links, g in done), key=repr)


FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("sent", [alignment.SENT, 40, 0])
def test_alignment_brute_force(spark, table, both, sent):
    rows = [(i, prose(i % 25, 20) + ["", " Élan ▁ x", "\n\n  don't stop  ", " <|endoftext|> <s>", " 日本語🙂 123,456"][i % 5]) for i in range(60)]
    rows += [(None, "one two"), (60, None), (61, ""), (62, " "), (62, "a b"), (62, "a b"), (63, "x\0y"), (64, "(" * 400)]
    got = written(alignment.aligned(table(rows), settings.byte_bpe(), settings.piece_bpe()), "aligned")
    out = alignment.digests(got, alignment.pair_counts(got), sent).collect()
    assert sorted((tuple(r[f] for f in FIELDS) for r in out), key=repr) == brute_alignment(both, rows)


def test_alignment_odd_rows(spark, odd, both):
    got = written(alignment.aligned(odd, settings.byte_bpe(), settings.piece_bpe()), "aligned")
    rows = alignment.digests(got, alignment.pair_counts(got)).collect()
    assert len(rows) == odd.count() and {r.n_a for r in rows if r.doc_id in (1, 2)} == {0}
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in rows)
    assert max(r.n_a for r in rows) > 50_000
    none = written(alignment.aligned(odd.limit(0), settings.byte_bpe(), settings.piece_bpe()), "aligned")
    assert alignment.digests(none, alignment.pair_counts(none)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_alignment_of_given_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.where("n_chars < 1500").orderBy("doc_id").limit(40).collect()]
    got = written(alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string"), settings.byte_bpe(), settings.piece_bpe()), "aligned")
    out = alignment.digests(got, alignment.pair_counts(got), 100).collect()
    assert sorted((tuple(r[f] for f in FIELDS) for r in out), key=repr) == brute_alignment(both, rows)
