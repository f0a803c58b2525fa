"""Graph assembly and graph query entries (inventory groups E and F)."""

from pyspark.sql import functions as F

from corpusgraph.functions import paths
from corpusgraph.operators import build, importance as im, traverse as tv
from corpusgraph.rules import graph as gr

from . import views as vw
from .q_extract import q
from .q_tags import units
from .registry import query
from .sqlbook import define
from .views import code_files, out, stored, view

ID = "substring(md5({0}), 1, 12)"
FID, SID = ID.format("path"), ID.format("concat(path, '::', name)")
WALK = "replace(path, '/', chr(1))"


#: Columns of units that hold no tags: what edges, ids and answers are made of.
LINKED = "repo_id path language kind seq name line_start line_end bases imports call_tokens is_first id file_id ord".split()


def unit_rows(spark, sf):
    """Units without tags, stored: storing them whole would compute the tags of every text for queries that read none."""
    return stored(spark, sf, "units", lambda: units(spark, sf, LINKED))


def nodes(spark, sf):
    return stored(spark, sf, "star_nodes", lambda: vw.star_nodes(spark, sf))


def edges(spark, sf):
    return stored(spark, sf, "star_edges", lambda: vw.star_edges(spark, sf))


# ---- E: assembly ----------------------------------------------------------------

define("o_nodes", f"""
SELECT repo_id, {FID} AS id, 'file' AS type, string_split(path, '/')[-1] AS name, path AS file_path, 1::BIGINT AS line_start,
  (length(content) - length(replace(content, chr(10), '')) + 1)::BIGINT AS line_end, language AS tags, language,
  concat(language, ' file (', length(content) - length(replace(content, chr(10), '')) + 1, ' lines)') AS summary,
  '' AS domain, '' AS role, '' AS effects, concat({WALK}, chr(1), chr(1), '0', lpad('0', 9, '0')) AS ord FROM {{code_files}}
UNION ALL SELECT repo_id, id, kind, name, path, line_start, line_end, '', language, summary, domain, role, effects, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY ord) AS rn FROM {{o_defs}}) d WHERE rn = 1""")
define("o_defs", f"""
SELECT *, {SID} AS id, {FID} AS file_id, concat({WALK}, chr(1), chr(1), CASE kind WHEN 'function' THEN '1' ELSE '2' END, lpad((seq + 1)::VARCHAR, 9, '0')) AS ord
FROM {{o_summaries}}""")
define("o_contains", "SELECT DISTINCT repo_id, file_id AS src, id AS dst FROM {o_defs}")
define("o_inherits", """
SELECT repo_id, class_id AS src, arg_max(base_id, base_ord) AS dst FROM (
  SELECT c.repo_id, c.id AS class_id, c.ord AS class_ord, b.base, d.id AS base_id, d.ord AS base_ord
  FROM {o_defs} c, unnest(string_split(c.bases, '|')) b(base) JOIN {o_defs} d ON d.repo_id = c.repo_id AND d.name = b.base AND d.ord <= c.ord
  WHERE c.kind = 'class') x GROUP BY repo_id, class_id, class_ord, base""")
define("o_aliases", f"""
SELECT repo_id, alias, arg_max(fid, walk) AS target FROM (
  SELECT repo_id, {FID} AS fid, {WALK} AS walk, unnest(list_distinct([lower(regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '')), lower(regexp_replace(path, '\\.[^./]+$', ''))])) AS alias FROM {{code_files}}) a
GROUP BY ALL""")
define("o_tried", r"""
SELECT repo_id, fid, source, u.n, lower(forms[u.n]) AS alias FROM (
  SELECT DISTINCT repo_id, substring(md5(path), 1, 12) AS fid, source, [source, replace(source, '.', '/'), replace(source, chr(92), '/'), string_split(source, '.')[-1], string_split(source, '/')[-1], string_split(source, chr(92))[-1]] AS forms
  FROM {o_imports}) s, unnest(range(1, 7)) u(n)""")
define("o_import_edges", """
SELECT DISTINCT repo_id, fid AS src, dst FROM (
  SELECT t.repo_id, t.fid, t.source, arg_min(a.target, t.n) AS dst FROM {o_tried} t JOIN {o_aliases} a ON a.repo_id = t.repo_id AND a.alias = t.alias GROUP BY ALL) x WHERE dst <> fid""")
_STOP = ", ".join(q(n) for n in gr.CALL_STOP_NAMES)
define("o_callables", f"""
SELECT repo_id, name AS token, arg_max(id, ord) AS target, arg_max(file_path, ord) AS target_path FROM {{o_nodes}}
WHERE type = 'function' AND length(name) >= 3 AND name NOT IN ({_STOP}) GROUP BY ALL""")
define("o_calls", """
SELECT c.repo_id, substring(md5(c.path), 1, 12) AS src, k.target AS dst FROM {call_sites} c JOIN {o_callables} k ON k.repo_id = c.repo_id AND k.token = c.token
ANTI JOIN {o_contains} h ON h.repo_id = c.repo_id AND h.src = substring(md5(c.path), 1, 12) AND h.dst = k.target""")
define("o_edges", """
SELECT repo_id, src, dst, 'contains' AS type, 0.5::DOUBLE AS weight FROM {o_contains}
UNION ALL SELECT DISTINCT repo_id, src, dst, 'inherits', 0.8::DOUBLE FROM {o_inherits}
UNION ALL SELECT repo_id, src, dst, 'imports', 0.6::DOUBLE FROM {o_import_edges}
UNION ALL SELECT repo_id, src, dst, 'calls', 0.4::DOUBLE FROM {o_calls}""")


@query("e1_ids", f"SELECT repo_id, path, name, {SID} AS id, {FID} AS file_id FROM {{o_symbols}}")
def e1(spark, sf):
    from corpusgraph.operators import extract as xt
    s = xt.symbols(xt.extracted(code_files(spark, sf)))
    return s.select("repo_id", "path", "name", paths.node_id(F.col("path"), F.col("name")).alias("id"), paths.node_id(F.col("path")).alias("file_id"))


def flat_nodes(n):
    return n.select("repo_id", "id", "type", "name", "file_path", F.col("line_range.start").alias("line_start"), F.col("line_range.end").alias("line_end"),
                    "tags", "language", "summary", tv.domain_of().alias("domain"), tv.role_of().alias("role"), tv.effect_types(n).alias("effects"), "ord")


@query("e2_nodes", "SELECT * FROM {o_nodes}")
def e2(spark, sf):
    return out(flat_nodes(build.nodes(units(spark, sf))))


@query("e2_first_per_id", "SELECT repo_id, name, count(*)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS rn FROM {star_nodes}) x WHERE rn = 1 GROUP BY ALL")
def e2_dups(spark, sf):
    renamed = nodes(spark, sf).withColumn("id", F.col("name"))
    return build.first_per_id(renamed).groupBy("repo_id", "name").agg(F.count("*").alias("n"))


def _edge_query(name, source, kind, fn):
    @query(name, f"SELECT DISTINCT repo_id, src, dst, '{kind}' AS type, {gr.EDGE_WEIGHTS[kind]}::DOUBLE AS weight FROM {{{source}}}")
    def run(spark, sf):
        return fn(unit_rows(spark, sf))
    return run


_edge_query("e3_contains", "o_contains", "contains", build.contains_edges)
_edge_query("e4_inherits", "o_inherits", "inherits", build.inherits_edges)
_edge_query("e5_imports", "o_import_edges", "imports", build.imports_edges)
_edge_query("e6_calls", "o_calls", "calls", build.calls_edges)


@query("e7_edges", "SELECT * FROM {o_edges}")
def e7(spark, sf):
    u = unit_rows(spark, sf)
    e = build.edges(u)
    return build.distinct_edges(e.unionByName(build.contains_edges(u)))


LAYER_SQL = "CASE " + " ".join(f"WHEN list_has_any(string_split(lower(file_path), '/'), [{', '.join(q(w) for w in ws)}]) THEN '{lid}'" for lid, _, ws in gr.LAYERS) \
    + " " + " ".join(f"WHEN language IN ({', '.join(q(v) for v in ls)}) THEN '{lid}'" for lid, ls in gr.LANGUAGE_LAYERS.items()) + f" ELSE '{gr.DEFAULT_LAYER}' END"
LAYER_NAME = "CASE layer_id " + " ".join(f"WHEN '{lid}' THEN '{name}'" for lid, name, _ in gr.LAYERS) + " END"
define("star_layer", f"SELECT *, {LAYER_NAME} AS layer_name FROM (SELECT *, {LAYER_SQL} AS layer_id FROM {{star_nodes}}) x")
define("code_layer", f"""SELECT repo_id, id, {LAYER_SQL} AS layer_id FROM (
  SELECT repo_id, {FID} AS id, path AS file_path, language FROM {{code_files}} UNION ALL SELECT repo_id, {FID}, path, 'html' FROM {{page_files}} UNION ALL SELECT repo_id, {FID}, path, 'markdown' FROM {{doc_files}}) x""")


@query("e8_layers", "SELECT * FROM {code_layer}")
def e8(spark, sf):
    rows = code_files(spark, sf).select("repo_id", "path", "language")
    for v, lang in (("page_files", "html"), ("doc_files", "markdown")):
        rows = rows.unionByName(view(spark, sf, v).select("repo_id", "path", F.lit(lang).alias("language")))
    return build.node_layers(rows.select("repo_id", paths.node_id(F.col("path")).alias("id"), F.col("path").alias("file_path"), "language"))


@query("e9_layer_sizes", f"SELECT repo_id, layer_id, count(*)::BIGINT AS nodes, {LAYER_NAME} AS name FROM {{code_layer}} GROUP BY ALL")
def e9(spark, sf):
    return build.layer_sizes(e8(spark, sf))


@query("e10_modules", "SELECT repo_id, module, count(*)::BIGINT AS files FROM (SELECT repo_id, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'root' END AS module FROM {all_paths}) x GROUP BY ALL")
def e10(spark, sf):
    from .q_scan import all_paths
    rows = all_paths(spark, sf).select("repo_id", paths.node_id(F.col("path")).alias("id"), F.col("path").alias("file_path"), F.lit("file").alias("type"))
    return build.modules(rows).groupBy("repo_id", "module").agg(F.count("*").alias("files"))


@query("e11_totals", """
SELECT repo_id, 'nodes' AS section, type AS key, count(*)::BIGINT AS n FROM {star_nodes} GROUP BY ALL
UNION ALL SELECT repo_id, 'files', language, n FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, language) AS r FROM (SELECT repo_id, language, count(*)::BIGINT AS n FROM {star_nodes} WHERE type = 'file' GROUP BY ALL) y) x WHERE r <= 8
UNION ALL SELECT repo_id, 'graph', 'nodes', count(*)::BIGINT FROM {star_nodes} GROUP BY ALL
UNION ALL SELECT repo_id, 'graph', 'edges', count(*)::BIGINT FROM {star_edges} GROUP BY ALL
UNION ALL SELECT repo_id, 'graph', 'layers', count(DISTINCT layer_id)::BIGINT FROM {star_layer} GROUP BY ALL""")
def e11(spark, sf):
    n = nodes(spark, sf)
    return build.totals(n, edges(spark, sf), build.node_layers(n))


# ---- F: queries -------------------------------------------------------------------

@query("f1_callers", "SELECT repo_id, dst AS id, src AS caller FROM {star_edges} WHERE type = 'calls' AND starts_with(dst, 'S')")
def f1(spark, sf):
    return tv.callers(edges(spark, sf), nodes(spark, sf).where(F.startswith("id", F.lit("S"))))


@query("f1_callers_of_functions", """
SELECT e.repo_id, f.name AS function, count(*)::BIGINT AS callers FROM {o_calls} e JOIN {o_nodes} f ON f.repo_id = e.repo_id AND f.id = e.dst GROUP BY ALL""")
def f1_corpus(spark, sf):
    return most_called(spark, sf)


def most_called(spark, sf):
    """Which functions are called from how many files, from source text to ranking."""
    u = unit_rows(spark, sf)
    names = u.where("kind = 'function' and is_first").select("repo_id", F.col("id").alias("dst"), F.col("name").alias("function"))
    return build.calls_edges(u).join(names, ["repo_id", "dst"]).groupBy("repo_id", "function").agg(F.count("*").alias("callers"))


@query("f2_callees", "SELECT repo_id, src AS id, dst AS callee FROM {star_edges} WHERE type = 'calls' AND starts_with(src, 'C')")
def f2(spark, sf):
    return tv.callees(edges(spark, sf), nodes(spark, sf).where(F.startswith("id", F.lit("C"))))


_EFF = "list_has_any(list_concat(string_split(effects_text, ','), list_transform(string_split(effects_text, ','), lambda e: string_split(e, ':')[1])), ['{0}'])"


@query("f3_find", f"""
SELECT repo_id, id, name FROM {{star_nodes}} WHERE type = 'function' AND domain = 'economy' AND {_EFF.format('db_write')} AND contains(lower(name), 'ring')
UNION ALL SELECT repo_id, concat('x', id), name FROM {{star_nodes}} WHERE {_EFF.format('external_api:stripe')} AND type = 'class'""")
def f3(spark, sf):
    n = nodes(spark, sf)
    a = tv.find(n, type="function", domain="economy", effect="db_write", name="Ring").select("repo_id", "id", "name")
    return a.unionByName(tv.find(n, type="class", effect="external_api:stripe").select("repo_id", F.concat(F.lit("x"), "id").alias("id"), "name"))


@query("f3_find_limited", "SELECT id, name FROM {star_nodes} WHERE type = 'function' ORDER BY ord LIMIT 50")
def f3_top(spark, sf):
    return tv.find(nodes(spark, sf), type="function", limit=50).select("id", "name")


@query("f4_names", "SELECT repo_id, name, arg_max(id, ord) AS id FROM {star_nodes} GROUP BY ALL")
def f4(spark, sf):
    return tv.resolved_names(nodes(spark, sf))


define("adj", "SELECT src AS id, dst AS nxt, type FROM {star_edges} WHERE type IN ('calls', 'imports') UNION ALL SELECT dst, src, type FROM {star_edges} WHERE type IN ('calls', 'imports')")
define("seeds", "SELECT name AS seed, arg_max(id, ord) AS id FROM {star_nodes} WHERE (id IN ('S0', 'S5', 'C7') OR starts_with(id, 'N')) GROUP BY ALL")
define("hop1", "SELECT DISTINCT s.seed, a.nxt AS id FROM {seeds} s JOIN {adj} a ON a.id = s.id ANTI JOIN {seeds} v ON v.seed = s.seed AND v.id = a.nxt")
define("hop2", "SELECT DISTINCT s.seed, a.nxt AS id FROM {hop1} s JOIN {adj} a ON a.id = s.id ANTI JOIN (SELECT * FROM {seeds} UNION ALL SELECT * FROM {hop1}) v ON v.seed = s.seed AND v.id = a.nxt")
define("impacted", "SELECT seed, id, 0::BIGINT AS hops FROM {seeds} UNION ALL SELECT seed, id, 1 FROM {hop1} UNION ALL SELECT seed, id, 2 FROM {hop2}")


def seeds(spark, sf):
    n = nodes(spark, sf).where(F.col("id").isin("S0", "S5", "C7") | F.startswith("id", F.lit("N")))
    return tv.named(nodes(spark, sf), n).join(n.select("repo_id", "name"), ["repo_id", "name"], "left_semi").withColumnRenamed("name", "seed")


@query("f5_impact", "SELECT seed, id, hops FROM {impacted}")
def f5(spark, sf):
    return out(tv.impact(seeds(spark, sf), edges(spark, sf)).drop("repo_id"))


@query("f6_impact_of_sets", "SELECT set_id, id, min(hops)::BIGINT AS hops FROM (SELECT CASE WHEN starts_with(seed, 'N') THEN 'nations' ELSE 'rest' END AS set_id, id, hops FROM {impacted}) x GROUP BY ALL")
def f6(spark, sf):
    sets = seeds(spark, sf).withColumn("set_id", F.when(F.startswith("seed", F.lit("N")), "nations").otherwise("rest"))
    return out(tv.impact(sets, edges(spark, sf), key="set_id").drop("repo_id"))


define("pairs", "SELECT concat('p', s_suppkey) AS pair, concat('C', s_suppkey % 7) AS src, concat('S', s_suppkey) AS dst FROM {supplier} WHERE s_suppkey % 20 = 0 UNION ALL SELECT 'self', 'C3', 'C3' UNION ALL SELECT 'none', 'C3', 'N1'")
define("calls_adj", "SELECT * FROM {adj} WHERE type = 'calls'")
define("lv0", "SELECT pair, src AS id, NULL::VARCHAR AS parent FROM {pairs}")
for _i in range(1, 7):
    _seen = " UNION ALL ".join(f"SELECT pair, id FROM {{lv{j}}}" for j in range(_i))
    define(f"lv{_i}", f"""SELECT l.pair, a.nxt AS id, min(l.id) AS parent FROM {{lv{_i - 1}}} l JOIN {{calls_adj}} a ON a.id = l.id ANTI JOIN ({_seen}) v ON v.pair = l.pair AND v.id = a.nxt
WHERE l.pair NOT IN (SELECT v.pair FROM ({_seen}) v JOIN {{pairs}} p ON p.pair = v.pair AND p.dst = v.id) GROUP BY ALL""")
for _i in range(6, -1, -1):
    _from = "" if _i == 6 else f" UNION ALL SELECT l.pair, l.id, l.parent FROM {{lv{_i}}} l JOIN {{pw{_i + 1}}} w ON w.pair = l.pair AND w.parent = l.id"
    define(f"pw{_i}", f"SELECT l.pair, l.id, l.parent FROM {{lv{_i}}} l JOIN {{pairs}} p ON p.pair = l.pair AND p.dst = l.id" + _from)


@query("f7_shortest_path", " UNION ALL ".join(f"SELECT pair, {i}::BIGINT AS step, id FROM {{pw{i}}}" for i in range(7)))
def f7(spark, sf):
    sup = view(spark, sf, "supplier").where("s_suppkey % 20 = 0")
    s = F.lit("star").alias("repo_id")
    pairs = sup.select(F.concat(F.lit("p"), "s_suppkey").alias("pair"), s, F.concat(F.lit("C"), F.col("s_suppkey") % 7).alias("src"), F.concat(F.lit("S"), "s_suppkey").alias("dst"))
    extra = view(spark, sf, "region").where("r_regionkey = 0").select(F.explode(F.array(
        F.struct(F.lit("self").alias("pair"), s, F.lit("C3").alias("src"), F.lit("C3").alias("dst")),
        F.struct(F.lit("none").alias("pair"), s, F.lit("C3").alias("src"), F.lit("N1").alias("dst")))).alias("x")).select("x.*")
    return out(tv.shortest_paths(pairs.unionByName(extra), edges(spark, sf), max_depth=6).drop("repo_id"))


def _listing(me, other, out_name):
    return f"""SELECT e.{me} AS id, count(*)::BIGINT AS {out_name}_total, array_to_string((list(n.name ORDER BY e.{other}))[1:10], '|') AS {out_name}
FROM {{star_edges}} e JOIN {{star_nodes}} n ON n.id = e.{other} WHERE e.type = 'calls' GROUP BY ALL"""


define("caller_list", _listing("dst", "src", "callers"))
define("callee_list", _listing("src", "dst", "callees"))


@query("f8_explain", """
SELECT n.id, n.name, n.type, n.file_path, n.summary, n.complexity, n.domain, n.role, coalesce(a.callers, '') AS callers, coalesce(a.callers_total, 0)::BIGINT AS callers_total,
  coalesce(b.callees, '') AS callees, coalesce(b.callees_total, 0)::BIGINT AS callees_total
FROM {star_nodes} n LEFT JOIN {caller_list} a ON a.id = n.id LEFT JOIN {callee_list} b ON b.id = n.id""")
def f8(spark, sf):
    n = nodes(spark, sf)
    x = tv.explain(n, edges(spark, sf), n)
    text = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    return x.select("id", "name", "type", "file_path", "summary", "complexity", tv.domain_of().alias("domain"), tv.role_of().alias("role"),
                    text("callers"), F.col("callers_total").cast("bigint"), text("callees"), F.col("callees_total").cast("bigint"))


@query("f9_one_hop", "SELECT DISTINCT set_id, id FROM (SELECT 's' || (k % 3) AS set_id, id FROM {star_nodes} WHERE type = 'class' UNION ALL SELECT 's' || (k % 3), a.nxt FROM {star_nodes} n JOIN {adj} a ON a.id = n.id WHERE n.type = 'class') x")
def f9(spark, sf):
    key = F.expr("cast(substring(id, 2) as bigint)")
    sets = nodes(spark, sf).where(F.col("type") == "class").select(F.concat(F.lit("s"), key % 3).alias("set_id"), "repo_id", "id")
    return tv.one_hop(sets, edges(spark, sf)).drop("repo_id")


define("top_calls", """
SELECT * FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n.ord, dst) AS rank FROM {star_edges} e JOIN {star_nodes} n ON n.id = e.dst WHERE e.type = 'calls') x WHERE rank <= 3""")


def define_chains(name, entries):
    """Twin of the limited chains: the star graph has call paths of at most three hops."""
    e = "{" + entries + "}"
    define(name + "_first", f"""SELECT entry, id, min(p) AS p FROM (
SELECT id AS entry, id, [0] AS p FROM {e}
UNION ALL SELECT c.id, a.dst, [0, a.rank] FROM {e} c JOIN {{top_calls}} a ON a.src = c.id
UNION ALL SELECT c.id, b.dst, [0, a.rank, b.rank] FROM {e} c JOIN {{top_calls}} a ON a.src = c.id JOIN {{top_calls}} b ON b.src = a.dst
UNION ALL SELECT c.id, d.dst, [0, a.rank, b.rank, d.rank] FROM {e} c JOIN {{top_calls}} a ON a.src = c.id JOIN {{top_calls}} b ON b.src = a.dst JOIN {{top_calls}} d ON d.src = b.dst) x GROUP BY ALL""")
    define(name, f"SELECT entry, id, (row_number() OVER (PARTITION BY entry ORDER BY p) - 1)::BIGINT AS step FROM {{{name}_first}}")


define("chain_entries", "SELECT id FROM {star_nodes} WHERE type = 'class'")
define_chains("chains_full", "chain_entries")


@query("f10_chains", "SELECT * FROM {chains_full} WHERE step < 6")
def f10(spark, sf):
    n = nodes(spark, sf)
    entries = n.where(F.col("type") == "class")
    return out(tv.chains(entries, n, edges(spark, sf)).drop("repo_id"))


@query("f10_chains_by_depth", "SELECT * FROM {chains_full}")
def f10_depth(spark, sf):
    n = nodes(spark, sf)
    entries = n.where(F.col("type") == "class")
    return out(tv.chains(entries, n, edges(spark, sf), max_nodes=2000, max_depth=6).drop("repo_id"))


define("visible", "SELECT id FROM {star_nodes} WHERE complexity <> 'simple'")


@query("f11_induced", "SELECT src, dst, type FROM {star_edges} SEMI JOIN {visible} a ON a.id = src SEMI JOIN {visible} b ON b.id = dst")
def f11(spark, sf):
    return tv.induced(edges(spark, sf), nodes(spark, sf).where("complexity <> 'simple'")).select("src", "dst", "type")


define("ends", "SELECT src AS id FROM {star_edges} UNION ALL SELECT dst FROM {star_edges}")


@query("f12_connected", "SELECT id FROM {star_nodes} WHERE id IN (SELECT id FROM {ends})")
def f12(spark, sf):
    return tv.connected(nodes(spark, sf), edges(spark, sf)).select("id")


@query("f13_degrees", "SELECT id, count(*)::BIGINT AS degree FROM {ends} GROUP BY ALL")
def f13(spark, sf):
    return tv.degrees(edges(spark, sf)).select("id", "degree")


define("call_pairs", "SELECT DISTINCT src, dst FROM {star_edges} WHERE type = 'calls'")
define("direct_n", "SELECT dst AS id, count(*) AS n FROM {call_pairs} GROUP BY ALL")
define("indirect_n", """
SELECT id, count(*) AS n FROM (SELECT DISTINCT a.dst AS id, b.src AS far FROM {call_pairs} a JOIN {call_pairs} b ON b.dst = a.src) x
ANTI JOIN {call_pairs} d ON d.dst = x.id AND d.src = x.far GROUP BY ALL""")
define("imp_scores", """
SELECT n.id, least(100, CASE WHEN contains(effects_text, 'db_write') THEN 30 ELSE 0 END + CASE WHEN contains(effects_text, 'external_api') THEN 30 ELSE 0 END
  + least(coalesce(d.n, 0) * 10, 30) + least(coalesce(i.n, 0) * 5, 15) + CASE WHEN role IN ('entry_point', 'orchestrator') THEN 20 ELSE 0 END + CASE WHEN complexity = 'complex' THEN 10 ELSE 0 END)::BIGINT AS score
FROM {star_nodes} n LEFT JOIN {direct_n} d ON d.id = n.id LEFT JOIN {indirect_n} i ON i.id = n.id WHERE n.type IN ('function', 'class')""")
define("imp", """
SELECT s.id, s.score, round_even((r.rk - 1) / greatest(r.k - 1, 1)::DOUBLE, 3) AS importance FROM {imp_scores} s
JOIN (SELECT score, row_number() OVER (ORDER BY score) AS rk, count(*) OVER () AS k FROM (SELECT DISTINCT score FROM {imp_scores}) d) r ON r.score = s.score""")


@query("f14_scores", "SELECT id, score FROM {imp_scores}")
def f14(spark, sf):
    return out(im.scores(nodes(spark, sf), edges(spark, sf)).select("id", "score"))


@query("f15_percentiles", "SELECT id, score, importance FROM {imp}")
def f15(spark, sf):
    return out(im.importance(nodes(spark, sf), edges(spark, sf)).drop("repo_id"))


define("detail_rows", """
SELECT x.*, n.name AS other_name, count(*) OVER (PARTITION BY x.id, direction)::BIGINT AS total, row_number() OVER (PARTITION BY x.id, direction ORDER BY x.type, other)::BIGINT AS rank FROM (
  SELECT dst AS id, src AS other, type, 'in' AS direction FROM {star_edges} UNION ALL SELECT src, dst, type, 'out' FROM {star_edges}) x JOIN {star_nodes} n ON n.id = x.other""")


@query("f16_node_detail", "SELECT id, other, type, direction, rank, total, other_name FROM {detail_rows} WHERE rank <= 30")
def f16(spark, sf):
    n = nodes(spark, sf)
    return out(tv.edge_detail(n, edges(spark, sf), n).select("id", "other", "type", "direction", "rank", "total", "other_name"))


