"""Scan, source and sink queries (inventory group A)."""

from pyspark.sql import functions as F

from corpusgraph.functions import text as tx
from corpusgraph.functions.tables import new_path
from corpusgraph.rules import inventory as iv, scan
from corpusgraph.sources import files as fs, graph_io

from .registry import query
from .sqlbook import define
from .views import code_files, out, star_edges, star_nodes, view


def q(v):
    return "'" + v.replace("'", "''") + "'"


define("all_paths", """
SELECT repo_id, path, length FROM {code_files} UNION ALL SELECT repo_id, path, length FROM {noise_files}""")


def all_paths(spark, sf):
    cols = ["repo_id", "path", "length"]
    return view(spark, sf, "code_files").select(cols).unionByName(view(spark, sf, "noise_files").select(cols))


@query("a1_read_tree", """
SELECT repo_id, language, sum(length(content) - length(replace(content, chr(10), '')) + 1)::BIGINT AS lines
FROM {code_files} GROUP BY ALL""")
def a1(spark, sf):
    root = new_path(spark, "tree")
    code_files(spark, sf).select("repo_id", "language", F.col("content").alias("value")).write.partitionBy("repo_id", "language").text(root)
    tree = fs.read_tree(spark, root, max_kb=1 << 21).where(F.endswith("path", F.lit(".txt")))
    part = lambda k: F.regexp_extract("path", k + "=([^/]+)", 1)
    return (tree.groupBy(part("repo_id").alias("repo_id"), part("language").alias("language"))
            .agg(F.sum(tx.newlines(F.col("content"))).alias("lines")))


_NAMES = ", ".join(q(n) for n in scan.IGNORED_NAMES)
_ENDS = "(" + "|".join(e.replace(".", r"\.") for e in scan.IGNORED_ENDINGS) + ")$"
define("ignored_paths", f"""
SELECT repo_id, path, length,
  list_has_any(string_split(path, '/'), [{_NAMES}])
  OR len(list_filter(string_split(lower(path), '/'), lambda c: regexp_matches(c, '{_ENDS}'))) > 0
  OR len(list_filter(string_split(path, '/')[1:-2], lambda c: starts_with(c, '.'))) > 0 AS ignored
FROM {{all_paths}}""")


@query("a2_ignored_paths", "SELECT repo_id, path, ignored FROM {ignored_paths}")
def a2(spark, sf):
    return all_paths(spark, sf).select("repo_id", "path", fs.ignored(F.col("path")).alias("ignored"))


define("globbed", r"""
SELECT DISTINCT p.repo_id, p.path FROM {all_paths} p, unnest(range(1, len(string_split(p.path, '/')) + 1)) u(n), {globs} g
WHERE g.repo_id = p.repo_id AND (
  regexp_full_match(string_split(p.path, '/')[n], replace(replace(replace(rtrim(g.glob, '/'), '.', '\.'), '*', '.*'), '?', '.'))
  OR regexp_full_match(array_to_string(string_split(p.path, '/')[1:n], '/'), replace(replace(replace(g.glob, '.', '\.'), '*', '.*'), '?', '.')))""")


@query("a3_ignore_globs", """
SELECT p.repo_id, p.path FROM {all_paths} p ANTI JOIN {globbed} g ON p.repo_id = g.repo_id AND p.path = g.path""")
def a3(spark, sf):
    return fs.drop_globbed(all_paths(spark, sf), view(spark, sf, "globs")).select("repo_id", "path")


@query("a4_size_limit", "SELECT repo_id, path, length FROM {all_paths} WHERE length <= 512 * 1024")
def a4(spark, sf):
    return fs.within_size(all_paths(spark, sf), 512)


LANGUAGE_SQL = ("CASE lower(string_split(path, '/')[-1]) WHEN 'dockerfile' THEN 'dockerfile' WHEN 'makefile' THEN 'makefile' ELSE "
                "CASE regexp_extract(lower(string_split(path, '/')[-1]), '(\\.[^.]*)$', 1) "
                + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in scan.ENDING_LANGUAGE.items()) + " END END")


@query("a5_language", f"""
SELECT repo_id, path, language FROM (SELECT repo_id, path, {LANGUAGE_SQL} AS language FROM (
  SELECT repo_id, path FROM {{all_paths}} UNION ALL SELECT repo_id, path FROM {{page_files}} UNION ALL SELECT repo_id, path FROM {{doc_files}})) x
WHERE language IS NOT NULL""")
def a5(spark, sf):
    paths = all_paths(spark, sf).drop("length")
    for v in ("page_files", "doc_files"):
        paths = paths.unionByName(view(spark, sf, v).select("repo_id", "path"))
    return fs.with_language(paths)


@query("a2_a5_scan", f"""
SELECT repo_id, path, language FROM (
  SELECT p.repo_id, p.path, {LANGUAGE_SQL.replace("path", "p.path")} AS language FROM {{ignored_paths}} p
  ANTI JOIN {{globbed}} g ON p.repo_id = g.repo_id AND p.path = g.path WHERE NOT ignored ) x
WHERE language IS NOT NULL""")
def scan_all(spark, sf):
    return fs.scan_files(all_paths(spark, sf), view(spark, sf, "globs")).select("repo_id", "path", "language")


define("fingerprints", "SELECT repo_id, path, concat(length, ':', CAST(epoch(mtime) AS BIGINT)) AS fp FROM {code_files}")


@query("a6_fingerprints", "SELECT * FROM {fingerprints}")
def a6(spark, sf):
    return fs.fingerprints(code_files(spark, sf))


@query("a7_snapshot", "SELECT * FROM {fingerprints}")
def a7(spark, sf):
    path = new_path(spark, "snapshots")
    graph_io.save_snapshot(fs.fingerprints(code_files(spark, sf)), path, "1")
    return graph_io.load_snapshot(spark, path, "1")


@query("a8_graph_sink", """
SELECT type, count(*)::BIGINT AS n FROM {star_edges} GROUP BY ALL
UNION ALL SELECT concat('node:', type), count(*)::BIGINT FROM {star_nodes} GROUP BY ALL""")
def a8(spark, sf):
    from corpusgraph.operators import build
    path = new_path(spark, "graph")
    nodes = star_nodes(spark, sf)
    graph_io.save_graph(nodes, star_edges(spark, sf), build.node_layers(nodes), path)
    edges = graph_io.load_edges(spark, path + "/edges")
    back = graph_io.load_nodes(spark, path + "/nodes")
    return (edges.groupBy("type").agg(F.count("*").alias("n"))
            .unionByName(back.groupBy(F.concat(F.lit("node:"), "type").alias("type")).agg(F.count("*").alias("n"))))


define("star_flat", """
SELECT repo_id, id, type, name, file_path, summary, language AS tags, language, complexity, domain, role,
  replace(effects_text, ',', '|') AS effects, replace(flow_text, ',', '|') AS control_flow, 0.0::DOUBLE AS importance, ord FROM {star_nodes}""")


@query("a9_both_layouts", "SELECT * FROM {star_flat}")
def a9(spark, sf):
    from corpusgraph.operators import export
    path = new_path(spark, "documents")
    nodes = star_nodes(spark, sf)
    nodes.where(F.col("type") != "function").drop("line_range").write.json(path + "/part=nested")
    export.stripped_nodes(nodes.where(F.col("type") == "function")).write.json(path + "/part=flat")
    return out(graph_io.load_nodes(spark, path))


define("lines", """
SELECT repo_id, path, language, u.i::BIGINT AS line, string_split(content, chr(10))[u.i] AS text
FROM {code_files}, unnest(range(1, len(string_split(content, chr(10))) + 1)) u(i)""")


@query("a10_source_lines", """
SELECT l.repo_id, concat('n', k) AS id, line, text FROM {lines} l JOIN {code_files} f ON f.repo_id = l.repo_id AND f.path = l.path
WHERE line BETWEEN 1 + k % 5 AND 4 + k % 5""")
def a10(spark, sf):
    files = view(spark, sf, "code_files")
    ranges = files.select("repo_id", F.concat(F.lit("n"), "k").alias("id"), "path",
                          (F.lit(1) + F.col("k") % 5).cast("int").alias("line_start"), (F.lit(4) + F.col("k") % 5).cast("int").alias("line_end"))
    return out(fs.source_lines(ranges, files))


@query("a11_manifests", f"""
SELECT repo_id, path, folder, file_name, content FROM (
  SELECT *, string_split(path, '/')[-1] AS file_name, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END AS folder FROM {{manifests}}) m
WHERE len(string_split(path, '/')) <= 2 AND file_name IN ({", ".join(q(n) for n in iv.MANIFEST_NAMES)})
  AND NOT starts_with(folder, '.') AND folder NOT IN ('vendor', 'node_modules', '.git')""")
def a11(spark, sf):
    return fs.manifests(view(spark, sf, "manifests").drop("k"), iv.MANIFEST_NAMES, iv.SKIPPED_DIRS).select(
        "repo_id", "path", "folder", "file_name", "content")


@query("a15_changed_paths", "SELECT DISTINCT repo_id, path FROM {changes} WHERE kind IN ('staged', 'unstaged')")
def a15(spark, sf):
    return fs.changed_paths(view(spark, sf, "changes"))


@query("a15_changed_since_ref", "SELECT DISTINCT repo_id, path FROM {changes} WHERE ref = 'HEAD~3'")
def a15_ref(spark, sf):
    return fs.changed_paths(view(spark, sf, "changes"), "HEAD~3")
