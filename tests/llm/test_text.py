"""Word hashes against a plain loop, components against a plain search."""

import random
import re

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from corpusgraph.llm import components, text

PLAIN = re.compile(r"(?:[0-9A-Za-z_]|[^\x00-\x7f])+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab Z9_é\n.你́", max_size=40), max_size=8))
def test_words_are_runs(texts):
    w = text.words(pa.array(texts, pa.string()))
    want = [PLAIN.findall(t) for t in texts]
    assert list(w.count) == [len(x) for x in want]
    seen = {}
    for h, word in zip(w.hash, [x for t in want for x in t]):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_block_borders_do_not_matter(monkeypatch):
    texts = pa.array(["alpha beta " * 50, "x" * 500, "", "gamma"])
    want = text.words(texts)
    monkeypatch.setattr(text, "_BLOCK", 7)
    got = text.words(texts)
    assert (got.hash == want.hash).all() and (got.first == want.first).all() and (got.start == want.start).all()


def test_sequence_hash_tells_order():
    a = text.sequence_hash(text.words(pa.array(["a b c", "c b a", "A, b c!".lower(), ""])))
    assert (a[0] == a[2]).all() and (a[0] != a[1]).all() and (a[3] == 0).all()


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2080)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(find(x) == find(y) and x != y for y in root)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
