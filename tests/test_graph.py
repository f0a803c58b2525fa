"""Graph queries and order-dependent helpers against brute force on small fixtures."""

import itertools
import random

import pytest

from pyspark.sql import functions as F

from corpusgraph.functions import ordered
from corpusgraph.functions.tables import written
from corpusgraph.operators import batches as bt, build, explore as xo, export as xp, importance as im, refresh as rf, search, traverse as tv
from corpusgraph.schemas import NODES

EDGE = "repo_id string, src string, dst string, type string, weight double"


def make_nodes(spark, rows):
    full = []
    for i, (nid, typ, path, kw) in enumerate(rows):
        sem = None if typ == "file" else ([(t, 0.7, "regex") for t in kw.get("effects", [])], [], kw.get("domain", ""), kw.get("role", ""), 0.0)
        full.append(("r", nid, typ, kw.get("name", nid), path, (1, 1), kw.get("summary", ""), [], kw.get("language", "python"), kw.get("complexity", "simple"), sem, f"{i:09d}"))
    return spark.createDataFrame(full, NODES)


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    ids = [f"n{i:02d}" for i in range(40)]
    edges = set()
    for _ in range(90):
        a, b = rng.sample(ids[:36], 2)
        edges.add((a, b, rng.choice(["calls", "calls", "imports", "contains"])))
    for i in ids[1:30]:                      # one hub that holds a third of all edges
        edges.add((i, "n00", "calls"))
        edges.add(("n00", i, "calls"))
    nodes = make_nodes(spark, [(i, "function", f"a/{i}.py", {"role": "entry_point" if k % 5 == 0 else "", "effects": ["db_write:x"] if k % 3 == 0 else []})
                               for k, i in enumerate(ids)])
    return nodes, spark.createDataFrame([("r", *e, 0.5) for e in sorted(edges)], EDGE), ids, sorted(edges)


def test_impact_matches_search(spark, graph):
    _, edges, ids, raw = graph
    adj = {}
    for a, b, t in raw:
        if t in ("calls", "imports"):
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    seeds = spark.createDataFrame([(i, "r", i) for i in ids[30:]], "seed string, repo_id string, id string")
    got = {}
    for depth in (1, 2):
        got[depth] = {(r.seed, r.id) for r in tv.impact(seeds, edges, max_depth=depth).collect()}
        want = set()
        for s in ids[30:]:
            seen, front = {s}, {s}
            for _ in range(depth):
                front = {n for f in front for n in adj.get(f, ())} - seen
                seen |= front
            want |= {(s, n) for n in seen}
        assert got[depth] == want
    assert got[1] <= got[2]


def test_shortest_paths(spark, graph):
    _, edges, ids, raw = graph
    adj = {}
    for a, b, t in raw:
        if t == "calls":
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)

    def distance(s, d):
        seen, front, n = {s}, {s}, 0
        while front:
            if d in front:
                return n
            front = {x for f in front for x in adj.get(f, ())} - seen
            seen |= front
            n += 1
        return None

    wanted = [(f"{a}-{b}", "r", a, b) for a, b in itertools.islice(itertools.combinations(ids[28:], 2), 30)]
    rows = tv.shortest_paths(spark.createDataFrame(wanted, "pair string, repo_id string, src string, dst string"), edges).collect()
    paths = {}
    for r in rows:
        paths.setdefault(r.pair, {})[r.step] = r.id
    for pair, _, a, b in wanted:
        d = distance(a, b)
        if d is None:
            assert pair not in paths
            continue
        p = [paths[pair][i] for i in range(d + 1)]
        assert p[0] == a and p[-1] == b and len(paths[pair]) == d + 1
        assert all(y in adj[x] for x, y in zip(p, p[1:]))


@pytest.mark.parametrize("hub", [3, 100_000])
def test_shortest_paths_from_both_ends(spark, hub):
    """The same nodes as a search from the source alone with the smallest parent, over chains, hubs, and pairs without a path."""
    rng = random.Random(11)
    calls = {(f"k{i:02d}", f"k{i + 1:02d}") for i in range(14)} | {("k14", "h"), ("h", "t00")} | {(f"x{i:02d}", "h") for i in range(40)}
    calls |= {tuple(f"m{rng.randrange(40):02d}" for _ in range(2)) for _ in range(55)} | {("h", "m03"), ("t00", "t01"), ("lone", "lone")}
    adj = {}
    for a, b in calls:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)

    def path(src, dst, most):
        parent, front, steps = {src: None}, [src], 0
        while front and dst not in parent and (most is None or steps < most):
            level = {}
            for x in front:
                for y in adj.get(x, ()):
                    if y not in parent:
                        level[y] = min(level.get(y, x), x)
            parent.update(level)
            front, steps = list(level), steps + 1
        out = [dst] if dst in parent else []
        while out and parent[out[0]] is not None:
            out.insert(0, parent[out[0]])
        return out

    ids = sorted(adj)
    wanted = [("k00", "t01"), ("t01", "k00"), ("k00", "k00"), ("k00", "lone"), ("lone", "lone"), ("gone", "k00"), ("gone", "gone"), ("x01", "x02"), ("k05", None)]
    wanted += [(rng.choice(ids), rng.choice(ids)) for _ in range(60)]
    pairs = spark.createDataFrame([(f"p{i}", "r", *w) for i, w in enumerate(wanted)], "pair string, repo_id string, src string, dst string")
    edges = spark.createDataFrame([("r", a, b, "calls", 1.0) for a, b in sorted(calls)] + [("s", "k00", "t01", "calls", 1.0), ("r", "k00", "t01", "imports", 1.0)], EDGE)
    for most in (None, 5)[:1 if hub == 3 else 2]:
        got = {}
        for r in tv.shortest_paths(pairs, edges, max_depth=most, hub=hub).collect():
            got.setdefault(r.pair, {})[r.step] = r.id
        assert {p: [s[i] for i in range(len(s))] for p, s in got.items()} == {
            f"p{i}": path(*w, most) for i, w in enumerate(wanted) if w[1] and path(*w, most)}
    assert tv.shortest_paths(pairs.limit(0), edges).count() == 0 and tv.shortest_paths(pairs, edges.limit(0)).count() == sum(a == b for a, b in wanted)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("adjacency_")]


def test_adjacency_is_not_exchanged(spark, graph):
    _, edges, _, _ = graph
    with search.stored(edges, hub=5) as adjacency:
        assert adjacency.hubs.count() > 0
        ids = written(spark.range(5000).select(F.lit("r").alias("repo_id"), F.format_string("n%02d", "id").alias("id"), F.lit(1).alias("k")))
        frontier = written(adjacency.placed(ids))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            plan = adjacency.reached(frontier, "k")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1, plan  # that of the frontier


def brute_callers(calls):
    direct = {}
    for src, dst in calls:
        direct.setdefault(dst, set()).add(src)
    out = {}
    for node, own in direct.items():
        far = set().union(*(direct.get(c, set()) for c in own)) - own
        out[node] = (len(own), min(len(far), im.CALLER_CAP))
    return out


def caller_counts(spark, calls):
    edges = spark.createDataFrame([("r", str(a), str(b), "calls") for a, b in calls] + [("r", "x", "y", "imports")], "repo_id string, src string, dst string, type string")
    return {int(r.id): (r.direct, min(r.indirect, im.CALLER_CAP)) for r in im.caller_counts(edges).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_caller_counts_brute_force(spark, seed):
    r = random.Random(seed)
    calls, base = set(), 0
    for size, p in [(6, .3), (12, .2), (12, .9), (9, 1.0), (30, .05), (30, .5), (5, .6), (20, .97)] * 3:
        own = range(base, base + size)
        calls |= {(a, b) for a in own for b in own if (a != b or r.random() < .3) and r.random() < p}
        # a few calls into and out of the group
        calls |= {(r.randrange(base + size), r.choice(own)) for _ in range(r.choice([0, 0, 1, 3]))}
        base += size
    calls |= {(a, 5000) for a in range(base)} | {(5001, 5000)}
    assert caller_counts(spark, calls) == brute_callers(calls)


def test_cliques_are_not_expanded(spark):
    """300 nodes that all call each other, one that they all call, one that calls one of them."""
    core = range(300)
    calls = {(a, b) for a in core for b in core if a != b} | {(a, 900) for a in core} | {(901, 0)}
    got = caller_counts(spark, calls)
    assert got[0] == (300, 1) and got[7] == (299, 2) and got[900] == (300, 1)


def test_importance(graph):
    nodes, edges, ids, raw = graph
    callers = {}
    for a, b, t in raw:
        if t == "calls":
            callers.setdefault(b, set()).add(a)
    want = {}
    for k, i in enumerate(ids):
        direct = callers.get(i, set())
        far = {c for d in direct for c in callers.get(d, set())} - direct
        want[i] = min(100, (30 if k % 3 == 0 else 0) + (20 if k % 5 == 0 else 0) + min(30, 10 * len(direct)) + min(15, 5 * len(far)))
    got = im.importance(nodes, edges).collect()
    assert {r.id: r.score for r in got} == want
    assert {r.importance for r in got} >= {0.0, 1.0}


@pytest.mark.parametrize("cap,depth", [(6, 6), (2000, 3)])
def test_chains(graph, cap, depth):
    nodes, edges, ids, raw = graph
    nexts = {}
    for a, b, t in raw:
        if t == "calls":
            nexts.setdefault(a, []).append(b)
    nexts = {a: sorted(b)[:3] for a, b in nexts.items()}

    def walk(start):
        chain, seen = [], set()

        def go(n, d):
            if n in seen or d > depth or len(chain) >= cap:
                return
            seen.add(n)
            chain.append(n)
            for m in nexts.get(n, []):
                go(m, d + 1)
        go(start, 0)
        return chain

    got = {}
    for r in tv.chains(nodes, nodes, edges, max_nodes=cap, max_depth=depth).orderBy("entry", "step").collect():
        got.setdefault(r.entry, []).append(r.id)
    assert got == {i: walk(i) for i in ids}


def test_ordered_helpers(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else "cold", f"{i:05d}", (str(i) if rng.random() < 0.2 else None)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o string, v string").repartition(4)
    got = {(r.k, r.o): (r.n, r.last) for r in ordered.latest_before(ordered.numbered(df, ["k"], ["o"], "n"), ["k"], ["o"], "v", "last").collect()}
    count, last = {}, {}
    for k, o, v in rows:
        count[k] = count.get(k, 0) + 1
        last[k] = v if v is not None else last.get(k)
        assert got[(k, o)] == (count[k], last[k])


def test_packing_matches_one_pass(spark):
    rng = random.Random(3)
    sizes = [rng.choice([1, 1, 2, 3, 40]) for _ in range(700)]
    rows = [("r", f"f{i:04d}.py", f"{i:04d}{j:03d}", f"{i}-{j}") for i, n in enumerate(sizes) for j in range(n)]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, priority string, id string").repartition(4)
    got = {r.file_path: r.batch for r in bt.packed(df).select("file_path", "batch").distinct().collect()}
    batch = files = nodes = 0
    for i, n in enumerate(sizes):
        assert got[f"f{i:04d}.py"] == batch
        files, nodes = files + 1, nodes + n
        if files >= 15 or nodes >= 30:
            batch, files, nodes = batch + 1, 0, 0


def test_base_class_defined_later_is_not_seen(spark):
    files = spark.createDataFrame([("r", p, "javascript", t) for p, t in [
        ("a.js", "class A extends Z {\n}\n"), ("b.js", "class Z {\n}\n"), ("c.js", "class C extends Z {\n}\nclass S extends S {\n}\n"), ("d/z.js", "class Z {\n}\n"),
        ("d-x/y.js", "class Y extends Z {\n}\n")]], "repo_id string, path string, language string, content string")
    u = build.units(files)
    name = {r.id: f"{r.path}:{r.name}" for r in u.collect()}
    got = {(name[r.src], name[r.dst]) for r in build.inherits_edges(u).collect()}
    assert got == {("c.js:C", "b.js:Z"), ("c.js:S", "c.js:S"), ("d-x/y.js:Y", "d/z.js:Z")}


def test_refresh_is_idempotent(graph, spark):
    nodes, edges, _, _ = graph
    changed = spark.createDataFrame([("r", "a/n01.py"), ("r", "a/n02.py")], "repo_id string, path string")
    new_nodes = nodes.where("id = 'n01'")
    new_edges = edges.where("src = 'n01'")
    once = rf.merge_nodes(nodes, new_nodes, changed)
    assert {r.id for r in once.collect()} == {r.id for r in nodes.collect()} - {"n02"}
    e1 = rf.merge_edges(edges, new_edges, nodes, once, changed)
    assert e1.where("src = 'n02' or dst = 'n02'").count() == 0
    twice = rf.merge_nodes(once, new_nodes, changed)
    assert twice.count() == once.count() and rf.merge_edges(e1, new_edges, once, twice, changed).count() == e1.count()
    fp = spark.createDataFrame([("r", "a", "1:2")], "repo_id string, path string, fp string")
    assert rf.unchanged(rf.diff_fingerprints(fp, fp))


def test_chunks_partition_every_layer(spark):
    rows = [(f"i{k}", "function", f"core/m{k % 3}/d{k % 7}/f{k}.py", {"summary": "s" * 50}) for k in range(300)]
    rows += [(f"j{k}", "function", "core/one/same.py", {"summary": "t" * 50}) for k in range(200)]      # one path over the limit
    nodes = make_nodes(spark, rows)
    got = xp.node_chunks(nodes, max_tokens=500, small=30, pool=5).collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows)
    sizes = {}
    for r in got:
        sizes[r.chunk] = sizes.get(r.chunk, 0) + 1
    assert sizes[[r.chunk for r in got if r.id == "j0"][0]] == 200


def test_limits_are_per_repository(spark, graph):
    nodes = graph[0].select("*")
    both = nodes.unionByName(nodes.withColumn("repo_id", F.lit("other")))
    assert {tuple(r) for r in tv.find(both, type="function", limit=2).groupBy("repo_id").count().collect()} == {("r", 2), ("other", 2)}
    some = nodes.first().name
    found = xo.search(both, some, limit=1).collect()
    assert sorted(r.repo_id for r in found) == ["other", "r"] and all(some.lower() in f"{r.name} {r.file_path}".lower() for r in found)


def test_pairs_share_the_search_of_a_common_end(spark, monkeypatch):
    """However many pairs begin at a node, it is searched from once: stored level rows follow the ends, not the pairs."""
    calls = [("a", f"o{i}") for i in range(30)] + [(f"o{i}", f"p{i % 7}") for i in range(30)] + [(f"p{j}", f"s{j}{k}") for j in range(7) for k in range(12)]
    edges = spark.createDataFrame([("r", x, y, "calls", 1.0) for x, y in calls], EDGE)
    stored_rows, keep = [], search._Levels.add

    def counted(self, level):
        out = keep(self, level)
        stored_rows.append(out.count())
        return out

    monkeypatch.setattr(search._Levels, "add", counted)
    totals = {}
    for n in (1, 12):
        wanted = [(f"{j}{k}", "r", "a", f"s{j}{k}") for j in range(7) for k in range(n)]
        stored_rows.clear()
        pairs = spark.createDataFrame(wanted * 2, "pair string, repo_id string, src string, dst string")
        got = {}
        for r in tv.shortest_paths(pairs, edges).collect():
            got.setdefault(r.pair, []).append((r.step, r.id))
        firsts = {j: min(f"o{i}" for i in range(30) if i % 7 == j) for j in range(7)}
        assert {p: sorted(v) for p, v in got.items()} == {p: [(0, "a"), (1, firsts[int(p[0])]), (2, f"p{p[0]}"), (3, d)] for p, _, _, d in wanted}
        totals[n] = sum(stored_rows)
    # 84 pairs, 85 ends: each target's own row and its one neighbour, and one search from the source (38 nodes)
    assert totals[12] <= 2 * 84 + 38 + 84, totals
