"""Mixing, records, leaks, passages, vectors, urls, chats: brute force, round trips, odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings as hyp, strategies as st

from corpusgraph.llm import chat, mixing, records, settings, suffixes, templates, urls, vectors
from .conftest import prose


def test_rake_meets_marginals():
    present = np.random.default_rng(0).integers(50, 200, (4, 3, 2)).astype(float)
    targets = [np.array([.4, .2, .2, .2]), np.array([.5, .3, .2]), np.array([.5, .5])]
    x = mixing.rake(present, targets, 0.3 * present.sum())
    assert (x <= present).all() and abs(x.sum() - 0.3 * present.sum()) < 1
    for axis, t in enumerate(targets):
        got = x.sum(tuple(a for a in range(3) if a != axis))
        assert np.allclose(got / got.sum(), t, atol=1e-3)


def test_mixing_labels_and_decisions(spark, table):
    docs = table([(i, prose(i, 40), ["en", "de", "zz"][i % 3], f"src{i % 2}") for i in range(3000)])
    targets = {"source": {"src0": 0.7, "src1": 0.3}, "lang": {"en": 0.5, "de": 0.25, mixing.OTHER: 0.25}}
    rows = mixing.mixed(docs, mixing.described(docs), targets, 0.3).collect()
    assert len(rows) == 3000
    kept = sum(r.tokens for r in rows if r.kept)
    assert abs(sum(r.tokens for r in rows if r.kept and r.source == "src0") / kept - 0.7) < 0.05
    assert abs(kept / sum(r.tokens for r in rows) - 0.3) < 0.04
    for r in rows[:200]:
        words = [w for w in prose(r.doc_id, 40).split() if len(w) >= 6]
        term = min(words, key=lambda w: (-words.count(w), w))
        assert r.topic == f"topic{int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % 4}" and r.tokens == 40
        u = int(hashlib.md5(f"1:{r.doc_id}".encode()).hexdigest()[:12], 16) / 16**12
        assert r.kept == (u < r.probability)


def test_mixing_odd_rows(spark, odd):
    rows = mixing.mixed(odd, mixing.labelled(odd), settings.MIX, 0.5).collect()
    assert len(rows) == odd.count() and all(0 <= r.probability <= 1 for r in rows)
    assert mixing.mixed(odd.limit(0), mixing.labelled(odd.limit(0)), settings.MIX, 0.5).count() == 0


def test_mixing_samples_values_outside_the_targets(spark, table):
    def row(i):
        source, lang = f"src{i // 10 % 20}", ["en", "en", "de", "fr", "es"][i // 200 % 5]
        return (i, "up to it " * 10 if i % 10 == 4 else prose(i, 40), {2: None, 3: "it"}.get(i % 10, lang), {0: "blog", 1: None}.get(i % 10, source))
    docs = table([row(i) for i in range(4000)])
    rows = mixing.mixed(docs, mixing.described(docs), settings.MIX, 0.5).collect()
    assert all(r.probability > 0 for r in rows)
    kept = sum(r.tokens for r in rows if r.kept)
    assert abs(kept / sum(r.tokens for r in rows) - 0.5) < 0.04
    for outside, share in ((lambda r: r.source in (None, "blog"), 0.205), (lambda r: r.lang in (None, "it"), 0.205), (lambda r: r.topic == mixing.OTHER, 0.077)):
        assert abs(sum(r.tokens for r in rows if r.kept and outside(r)) / kept - share) < 0.03
    none = table([(i, prose(i, 40), None, "blog") for i in range(400)])
    assert 120 < sum(r.kept for r in mixing.mixed(none, mixing.described(none), settings.MIX, 0.5).collect()) < 280
    named = {"source": {"src0": 1.0, mixing.OTHER: 0.0}}
    assert {r.probability for r in mixing.mixed(none, mixing.described(none), named, 0.5).collect()} == {0.5}


BPE = settings.word_bpe()


@hyp(max_examples=150, deadline=None)
@given(st.text(alphabet="abÉé'’s1٣ \n\t\x1c\x85İΣς<|>endoftx!,.你ﬁ\u0301\u200b\u00a0", max_size=60))
def test_encoder_equals_whole_texts(text):
    e = records._encoder(BPE)
    assert e([text])[0] == np.array([*e.tokenizer.encode(text, add_special_tokens=False).ids, 1], e.kind).tobytes()


def test_records_round_trip(spark, odd):
    index = records.written(records.write(odd, BPE), "index")
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in records.read(index).collect()))
    tokenizer = records._encoder(BPE).tokenizer
    want, start = [], 0
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((start, r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    some = index.where("start > 100 and doc_id = 5")
    assert records.read(some).count() == some.count() > 0
    assert records.read(records.write(odd.limit(0), BPE)).count() == 0


def test_broken_records_are_noticed():
    record = records.framed(b"payload")
    assert records.unframed(b"xx" + record, 2) == b"payload"
    for i in range(len(record)):
        with pytest.raises(ValueError):
            records.unframed(record[:i] + bytes([record[i] ^ 1]) + record[i + 1:])
    with pytest.raises(ValueError):
        records.unframed(record[:-1])


QUESTION = "a train leaves the station and travels {a} km in {b} hours while {n} waits there for {a} minutes before it goes on"


def test_leaks(spark, table):
    items = spark.createDataFrame([(1, QUESTION.format(a="60", b="two", n="Alice")), (2, prose(50, 40)), (3, "tiny item here"), (4, None), (5, "")], "item_id long, text string")
    docs = table([(1, f"{prose(1, 30)}. {QUESTION.format(a='60', b='two', n='Alice')}. {prose(2, 30)}"),
                  (2, prose(3, 30) + ". " + QUESTION.format(a="1,250.5", b="9", n="Bob").upper().lower().replace("bob", "Bob") + " " + prose(4, 9)),
                  (3, QUESTION.format(a="60", b="two", n="Alice").replace("60 minutes", "70 minutes")),
                  (4, prose(5, 40)), (5, prose(6, 10) + " " + " ".join(prose(50, 40).split()[10:35])), (6, prose(50, 40).upper()), (7, "so tiny item here now")])
    got = {(r.doc_id, r.item_id): r.kind for r in templates.leaks(docs, items).collect()}
    # document 3 changes one occurrence of a value that recurs: the windows before it are a verbatim run
    assert got == {(1, 1): "verbatim", (2, 1): "reparameterised", (3, 1): "verbatim", (5, 2): "verbatim", (6, 2): "verbatim", (7, 3): "verbatim"}
    kept = templates.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4]


DENSE = ["What is 12 + 45 + 33 - 7 and then 9 times 4 less 3?", "Solve 3 x 4 = 12, 5 x 6 = 30, 7 x 8 = 56, 9 x 9 = 81 and 2 x 2 = 4",
         "The teams were Alice Brown, Bruno Costa, Carla Diaz, Dmitri Evans, Elena Fox, Farid Gold, Greta Hill, Hugo Ivanov and Ines Jung"]


def test_every_verbatim_copy_is_found(spark, table):
    """Items of numbers and names, in any case, and random items: all that brute force over plain words finds, nothing else."""
    rng = np.random.default_rng(3)
    parts = np.array("12 7 1,250.5 km Alice Bruno Berlin two hours apples the of runs over stone river Hill m 9".split())
    items = DENSE + [" ".join(rng.choice(parts, rng.integers(8, 30))) for _ in range(40)]
    texts = [f"{prose(100 + i, 20)}. {form(t)} {prose(200 + i, 20)}" for i, t in enumerate(items) for form in (str, str.lower, str.upper)]
    clean = [prose(300 + i, 60) for i in range(20)]
    docs = table(list(enumerate(texts + clean)))
    got = {(r.doc_id, r.item_id): r.kind for r in templates.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert all(got.get((3 * i + k, i)) == "verbatim" for i in range(len(items)) for k in range(3))
    assert not [d for d, _ in got if d >= len(texts)]


@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=3), max_size=9))
def test_longest_run_against_all_runs(rows):
    hits = [{"place": i, "slots": [a for a, _ in r], "values": [b for _, b in r]} for i, r in enumerate(rows)]
    best = (0, False)
    for i in range(len(rows)):
        for j in range(i, len(rows)):
            pairs = {p for r in rows[i:j + 1] for p in r}
            if len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs) and (j - i + 1) > best[0]:
                best = (j - i + 1, all(a == b for a, b in pairs))
    got = templates.longest_run(hits)
    assert got[0] == best[0]


def test_leaks_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, prose(5, 80)), (None, prose(1, 90))], "item_id long, text string")
    got = sorted(((r.doc_id or 0), r.item_id or 0) for r in templates.leaks(odd, items).collect())
    assert got == [(0, 0), (5, 1), (10, 1)]
    assert sorted((r.doc_id or 0) for r in templates.decontaminated(odd, items).collect()) == [1, 2, 3, 4, 5, 7, 8, 9]
    assert templates.leaks(odd.limit(0), items).count() == templates.leaks(odd, items.limit(0)).count() == 0
    assert templates.decontaminated(odd, items.limit(0)).count() == odd.count()


def test_passages_against_all_windows(spark, table):
    docs = [(i, prose(i, 120)) for i in range(40)]
    shared = [prose(900 + k, 50 + 7 * k) for k in range(8)]
    docs += [(100 + i, f"{prose(200 + i, 30 + i)} {shared[i % 8]} {prose(300 + i, 25)}") for i in range(40)]
    docs += [(200 + i, docs[i][1]) for i in range(5)] + [(300, "lo " * 400), (301, "lo " * 90), (302, prose(1, 49)), (303, (prose(77, 60) + " ") * 3)]
    docs += [(310, prose(5000, 40) + " " + " ".join(shared[7].split()[:49]) + " " + prose(5001, 40))]
    own = {}
    split = {i: re.findall(r"\w+", t.lower()) for i, t in docs}
    for i, w in split.items():
        for p in range(len(w) - 49):
            own.setdefault(tuple(w[p:p + 50]), set()).add(i)
    want = {}
    for i, w in split.items():
        marked = {q for p in range(len(w) - 49) if len(own[tuple(w[p:p + 50])]) > 1 for q in range(p, p + 50)}
        if marked:
            want[i] = marked
    got = {r.doc_id: {q for s in r.spans for q in range(s.start, s.end)} for r in suffixes.repeated(table(docs)).collect()}
    assert got == want


def passages(docs):
    """Words of each document in windows of 50 that another one has too."""
    own, want = {}, {}
    split = {i: re.findall(r"\w+", t.lower()) for i, t in docs}
    for i, w in split.items():
        for p in range(len(w) - 49):
            own.setdefault(tuple(w[p:p + 50]), set()).add(i)
    for i, w in split.items():
        marked = {q for p in range(len(w) - 49) if len(own[tuple(w[p:p + 50])]) > 1 for q in range(p, p + 50)}
        if marked:
            want[i] = marked
    return want


def test_passages_behind_closer_neighbours(spark, table):
    r = np.random.default_rng(5)
    lines = [prose(7000 + k, 19) for k in range(9)]
    docs = [(i, " ".join(lines[k] for k in r.integers(0, 9, 5)) + " " + prose(8000 + i, 12)) for i in range(300)]
    got = {d.doc_id: {q for s in d.spans for q in range(s.start, s.end)} for d in suffixes.repeated(table(docs)).collect()}
    assert got == passages(docs)


def test_passages_of_repeated_phrases(spark, table):
    docs = [(n, f"{prose(100 + n, 30)} {' '.join((prose(n // 4, 3 + n // 4 % 9).split() * 40)[:44 + 5 * (n % 4)])} {prose(500 + n, 30)}") for n in range(48)]
    docs += [(900 + n, " ".join(prose(40, 45).split()[:45 - n]) + " lo" * (20 + 3 * n) + " " + prose(600 + n, 20)) for n in range(12)]
    got = {d.doc_id: {q for s in d.spans for q in range(s.start, s.end)} for d in suffixes.repeated(table(docs)).collect()}
    assert got == passages(docs)


def test_passages_across_task_borders(spark, table, monkeypatch):
    passage = prose(1, 70)
    docs = table([(i, f"{prose(10 + i, 20)} {passage} {prose(500 + i, 20)}") for i in range(300)]).repartition(9)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = suffixes.repeated(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 300 and all(r.repeated_words >= 70 for r in got)


def test_passages_odd_rows(spark, odd):
    got = {r.doc_id: (r.repeated_words, r.partners) for r in suffixes.repeated(odd).collect()}
    assert got[5] == (80, [10]) and got[10] == (80, [5]) and set(got) == {5, 10}
    assert suffixes.repeated(odd.limit(0)).count() == 0


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + r.standard_normal(16) * 0.12 * (i % 4)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)] + [(3000, [2 * x for x in rows[5][1]])]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [math.nan] * 16), (4004, [None, *rows[0][1][1:]]), (4005, [math.inf, *rows[0][1][1:]]), (4006, rows[0][1][:8]), (rows[0][0], rows[0][1])]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    ids = sorted({i for i, _ in rows})
    v = {i: np.array(x, float) for i, x in rows if x and None not in x and np.isfinite(x).all() and any(x)}
    link = {i: [j for j in v if j != i and len(v[i]) == len(v[j]) and v[i] @ v[j] >= 0.9 * np.linalg.norm(v[i]) * np.linalg.norm(v[j])] for i in v}
    root = {i: i for i in ids}
    for _ in range(40):
        root = {i: min([root[i], *(root[j] for j in link.get(i, ()))]) for i in ids}
    assert got == {i: (len(link.get(i, ())), root[i], root[i] == i) for i in ids}
    assert vectors.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vector_recall_at_the_threshold():
    for n in (100, 50_000, 10**9):
        bits, count = vectors.tables(n)
        assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** count >= 0.999


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y", "http://example.net/EN/", "http://example.net", "x://badexample.com/de/", "http://example.com/de/#a", "http://a.org/fr/?q",
        "http://www.listed.com/a", "http://listed.com", "http://unlisted.com/", "http://É.org/fr/x", "http://h?/en/", "http://h#x", "://net/", "a://b://c/d", "http://" + "a." * 500 + "listed.com/" + "p" * 5000]


def plain_verdict(url, listed):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in RULES if (host == r[1].split("/")[0] or host.endswith("." + r[1].split("/")[0])) and path.startswith("/" + r[1].split("/", 1)[1])), key=lambda r: len(r[1]), default=None)
    parents = {".".join(host.split(".")[i:]) for i in range(len(host.split(".")))}
    return host, path, best and best[1], best[0] if best else "block" if parents & listed else "allow"


def test_urls(spark, monkeypatch):
    listed = {"listed.com", "never-seen.com", *(f"bad{i}.com" for i in range(150))}
    all_ = URLS + [f"http://{'bad' if i % 2 else 'good'}{i}.com/" for i in range(4000)] + ["http://listed.com"] * 3
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(all_)], "page_id long, url string, host string, rule string")
    keys = spark.createDataFrame([(k,) for k in listed] + [("listed.com",), (None,)], "key string")
    for most in (10**6, 10):
        monkeypatch.setattr(urls, "MAX_KEYS", most)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, RULES, keys).collect()}
        assert got == {i: plain_verdict(u, listed) for i, u in enumerate(all_)}
    assert urls.judged(pages.limit(0), RULES, keys).count() == 0
    assert urls.judged(pages, RULES, keys.limit(0)).where("rule is null and verdict = 'block'").count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(30_000).selectExpr("concat('k', id) as key")
    levels = urls.cascade(universe, universe.where("hash(key) % 5 = 0"))
    assert len(levels) > 2
    from pyspark.sql import functions as F
    assert universe.where(urls.contains(F.col("key"), levels) != (F.expr("hash(key) % 5 = 0"))).count() == 0


@hyp(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="user\n\\<|", max_size=6), st.text(alphabet="<\\|>im_startend\n a", max_size=30)), max_size=5))
def test_chat_round_trip(turns):
    parts = chat.segments([r for r, _ in turns], [t for _, t in turns])
    whole = "".join(p["text"] for p in parts)
    assert chat.parse(whole) == turns
    assert all(chat.unescape(p["text"]) == t for p, (_, t) in zip(parts[1::3], turns))
    assert whole.count("<|") == 2 * len(turns)


def test_turn_order():
    assert chat.order_error(["system", "user", "assistant"]) is None and chat.order_error(["user", "assistant", "user", "assistant"]) is None
    assert chat.order_error(["user", "user"]) == "turn 1: user after user" and chat.order_error([]) == "ends with nothing"
    assert chat.order_error(["user"]) == "ends with user" and chat.order_error(["tool"]) == "turn 0: tool after start"


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", None, 0), (1, 0, "user", "hé <|im_end|>", 0), (2, 0, None, "x", 0), (None, 0, "user", "a", 0), (None, None, "assistant", "b", 0), (3, 0, "user", "t" * 200_000, 0),
            (4, 0, "user", "b", 0), (4, 0, "user", "a", 0), (4, 0, "user", "a", 0), (2**60 + 1, 0, "user", "q", 0), (2**60, 0, "user", "r", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(turns)).collect()}
    sha = lambda *x: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in x).encode()).hexdigest()
    assert len(got) == 7 and got[1].turns_sha256 == sha(("user", "hé <|im_end|>"), ("assistant", "")) and got[1].loss_chars == 0 and got[1].error is None
    assert got[4].turns_sha256 == sha(("user", "a"), ("user", "a"), ("user", "b")) and got[None].turns_sha256 == sha(("assistant", "b"), ("user", "a")) and got[None].loss_chars == 1
    assert got[2].turns_sha256 == sha(("", "x")) and got[3].formatted_chars == 200_000 + 28 and got[2**60].n_turns == 1
    assert chat.digests(chat.formatted(turns.limit(0))).count() == 0
