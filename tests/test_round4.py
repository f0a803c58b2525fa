"""Work that must not grow faster than the input: results against brute force, and what the plans move."""

import re

from pyspark.sql import functions as F

from corpusgraph.functions import text as tx
from corpusgraph.operators import explore as xo, reports as rp, semantics as st, traverse as tv
from corpusgraph.rules import semantics as sm

from test_graph import EDGE, make_nodes


def _asked(spark, n):
    """``n`` questions with the same words, one with another, and one without any hit."""
    rows = [(f"q{i}", "r", "which Alpha node_1 fails") for i in range(n)] + [("x", "r", "pay for economy"), ("none", "r", "nothing here")]
    return spark.createDataFrame(rows, "question_id string, repo_id string, question string")


def _named(spark):
    return make_nodes(spark, [(f"n{i:02d}", "function", f"a/{i}.py", {
        "name": f"alpha_{i}" if i % 3 == 0 else f"node_{i}", "domain": "economy" if i % 4 == 0 else "", "effects": ["pay:x"] if i % 5 == 0 else []}) for i in range(20)])


def _expected(question, i):
    name = f"alpha_{i}" if i % 3 == 0 else f"node_{i}"
    return ("alpha" in name or "node_1" in name) if question.startswith("q") else (i % 4 == 0 or i % 5 == 0) if question == "x" else False


def test_retrieval_shuffles_sets_of_words_not_questions_with_nodes(spark):
    found = xo.retrieve(_asked(spark, 6), _named(spark), part=2)
    want = sorted((q, f"n{i:02d}") for q in [*(f"q{k}" for k in range(6)), "x"] for i in range(20) if _expected(q, i))
    assert sorted((r.question_id, r.id) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the rows of the result leave a join and are not exchanged again
    assert plan.index("Join") < plan.index("Aggregate")


def test_context_searches_once_per_word(spark, monkeypatch):
    seen, hop = [], tv.one_hop

    def counted(members, edges, **kw):
        out = hop(members, edges, **kw)
        seen.append(out.count())
        return out

    monkeypatch.setattr(xo.tv, "one_hop", counted)
    edges = spark.createDataFrame([("r", f"n{i:02d}", f"n{i + 1:02d}", "calls", 0.4) for i in range(19)], EDGE)
    for n in (2, 12):
        rows = xo.context(_asked(spark, n), _named(spark), edges, limit=4).collect()
        for q in [*(f"q{k}" for k in range(n)), "x"]:
            own = {i for i in range(20) if _expected(q, i)}
            near = sorted(own | {i + d for i in own for d in (-1, 1) if 0 <= i + d < 20})[:4]
            assert [r.id for r in sorted(rows, key=lambda r: r["rank"]) if r.question_id == q] == [f"n{i:02d}" for i in near]
        assert "none" not in {r.question_id for r in rows}
    assert seen[0] == seen[1]


def test_flows_gather_names_of_the_shown_chains_only(spark, monkeypatch):
    seen, chain_names = [], rp._chain_names

    def counted(chain_rows, nodes):
        seen.append(chain_rows.select("entry").distinct().count())
        return chain_names(chain_rows, nodes)

    monkeypatch.setattr(rp, "_chain_names", counted)
    ends = {"effects": ["external_api:stripe"]}
    nodes = make_nodes(spark, [(f"e{i:02d}", "function", f"controller/e{i}.py", {"role": "entry_point"}) for i in range(30)]
                       + [("apis", "function", "service/a.py", ends), ("plain", "function", "service/p.py", {})])
    edges = spark.createDataFrame([("r", f"e{i:02d}", "apis" if i % 3 == 2 else "plain", "calls", 0.4) for i in range(30)], EDGE)
    api = rp.api_flows(nodes, edges, shown=4).orderBy("rank").collect()
    assert [(r.entry, r.rank, [s.name for s in r.steps], r.effects) for r in api] == [
        (e, n, [e, "apis"], ["external_api:stripe"]) for n, e in enumerate(("e02", "e05", "e08", "e11"), 1)]
    assert seen == [4]
    requests = rp.request_flows(nodes, edges, shown=5).orderBy("rank").collect()
    assert [(r.entry, r.rank, len(r.layers)) for r in requests] == [(f"e{i:02d}", i + 1, 2) for i in range(5)]
    assert seen == [4, 5]


def test_chains_walk_batches_of_entries(spark):
    nodes = make_nodes(spark, [(f"n{i}", "function", f"a/{i}.py", {}) for i in range(6)])
    edges = spark.createDataFrame([("r", f"n{i}", f"n{i + 1}", "calls", 0.4) for i in range(4)], EDGE)
    rows = tv.chains(nodes, nodes, edges)
    assert "FlatMapGroupsInPandas" not in rows._jdf.queryExecution().toString()
    got = {}
    for r in rows.orderBy("entry", "step").collect():
        got.setdefault(r.entry, []).append(r.id)
    assert got == {f"n{i}": [f"n{k}" for k in range(i, 5)] if i < 5 else ["n5"] for i in range(6)}


def test_word_searches_before_patterns_change_no_tag(spark):
    """Every alternative of the patterns, in other cases and with letters beyond ASCII, gives what the pattern alone gives."""
    alternatives = {p for ps in (sm.EFFECT_PATTERNS, sm.CONTROL_PATTERNS) for pattern in ps.values() for p in pattern.split("|")}
    plain = [re.sub(r"\\b|\(\?s\)|\(\?:", "", p).replace(r"\w+", "x1").replace(r"\s*", " ").replace(".*", " ").replace("\\", "").rstrip(")") for p in alternatives]
    texts = [t for p in plain for t in (p, p.upper(), p.lower(), f"a {p} b", f"é{p}", f"{p} x:", p.replace("k", "\u212a").replace("s", "\u017f"), p[:-1])]
    texts += ["try { } catch (e)", "try:\n  x\nexcept", "catch try", "finally", "path(a).read", "fopen(f)", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", *[st.shows(e, F.col("t"), F.lower("t")).alias(e) for e in sm.EFFECT_PATTERNS],
                      *[tx.has(F.col("t"), p, "i").alias(f"{e}_") for e, p in sm.EFFECT_PATTERNS.items()],
                      st.control_flow(F.col("t")).alias("flow"), *[tx.has(F.col("t"), p).alias(n) for n, p in sm.CONTROL_PATTERNS.items()]).collect()
    for r in got:
        assert [r[e] for e in sm.EFFECT_PATTERNS] == [r[f"{e}_"] for e in sm.EFFECT_PATTERNS], r.t
        assert r.flow == [n for n in sm.CONTROL_PATTERNS if r[n]], r.t
    assert all(any(r[e] for r in got) for e in sm.EFFECT_PATTERNS)
