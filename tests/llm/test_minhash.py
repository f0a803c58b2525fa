"""Near-duplicate classes against all pairs by exact weighted Jaccard similarity."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from corpusgraph.llm import minhash, sketch
from corpusgraph.llm.text import strings, words
from .conftest import prose


def edited(text, seed, changes):
    r = random.Random(seed)
    w = text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = prose(r.random(), 1)
    return " ".join(w)


def brute(docs):
    """Components of weighted Jaccard >= 0.8 over all pairs, with exact document frequencies."""
    bags = {}
    for i, t in docs:
        w = words(strings(pa.array([t]))).hash.tolist()
        bags[i] = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    df = Counter(g for b in bags.values() for g in b)
    idf = {g: 1 + min(max(np.log(n / len(docs)) / np.log(sketch.RARE), 0), 1) for g, n in df.items()}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(bags)
    near = 0
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            keys = bags[i].keys() | bags[j].keys()
            low = sum(idf[g] * min(bags[i][g], bags[j][g]) for g in keys)
            high = sum(idf[g] * max(bags[i][g], bags[j][g]) for g in keys)
            if high and low / high >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            near += bool(high and 0.78 <= low / high < 0.8)
    return {i: find(i) for i in ids}


def corpus():
    docs, n = [], 0
    for group in range(12):
        base = prose(group, 150)
        for copy in range(8):
            docs.append((n, edited(base, copy, (copy * group) % 9)))
            n += 1
    passage = prose(777, 60)
    for k in range(30):  # documents that share a passage only
        docs.append((n, prose(1000 + k, 70) + " " + passage))
        n += 1
    return docs + [(n, "a b c"), (n + 1, "A, b; c!"), (n + 2, ""), (n + 3, "..")]


def test_all_pairs(spark, table, monkeypatch):
    docs = corpus()
    want = brute(docs)
    got = {r.doc_id: r.class_id for r in minhash.classes(table(docs)).collect()}
    assert got == want


def test_odd_rows(spark, odd):
    rows = minhash.classes(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.class_id)
    assert by[1] == {1} and by[2] == {2} and by[3] == {3} and by[8] == by[9] == {8} and by[10] == {5} and by[5] == {5}
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == {None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 7: 1, 8: 1}
    assert minhash.classes(odd.limit(0)).count() == 0 and minhash.deduplicated(odd.limit(0)).count() == 0


def test_samples_agree_as_often_as_documents_are_similar():
    r = np.random.default_rng(1)
    keys = np.sort(r.choice(2**50, 900, replace=False).astype(np.uint64))
    wa, wb = r.uniform(1, 4, 900), r.uniform(1, 4, 900)
    wa[:150], wb[-150:] = 0, 0
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    same = []
    for shift in range(60):
        k = keys ^ np.uint64(shift << 40)
        a, b = (minhash.samples(k[w > 0], w[w > 0], np.array([0])) for w in (wa, wb))
        same.append((a == b).mean())
    assert abs(np.mean(same) - want) < 0.03


def test_document_counts(spark, table):
    docs = table([(i, f"common words that all share {prose(i, 3)}") for i in range(40)])
    total, counts = minhash.corpus_counts(docs)
    keys = minhash.shingles(pa.array(["common words that all share"]))[1]
    assert total == 40 and min(counts[r][p[0]] for r, p in enumerate(sketch.places(keys))) == 40
    assert sketch.idf(keys, total, counts)[0] == 1


def test_blocks_compare_long_repetitive_texts(spark):
    texts = ["lo " * 20_000, "lo " * 19_900 + prose(1, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    total, counts = minhash.corpus_counts(docs)
    rows = spark.createDataFrame([(b"b", 0, 0, bytes([i]), bytes([i]), 0) for i in range(2)], "bucket binary, lo int, hi int, v binary, root binary, tile int")
    contents = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "content binary, text string")
    assert minhash.compared(rows, contents, total, counts, 0.8).count() == 1
