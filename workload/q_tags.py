"""Semantic tag and complexity queries (inventory groups C and D)."""

from pyspark.sql import functions as F

from corpusgraph.functions import text as tx
from corpusgraph.operators import build, complexity as cp, extract as xt, semantics as st
from corpusgraph.rules import complexity as cx, semantics as sm

from .q_extract import ext, q
from .registry import query
from .sqlbook import define
from .views import code_files, out, view

# ---- C -----------------------------------------------------------------------

define("file_imports", "SELECT repo_id, path, list(source ORDER BY seq) AS sources FROM {o_imports} GROUP BY ALL")


def _services(names):
    return "[" + ", ".join(q(n) for n in names) + "]"


_ENT = q(sm.ENTITY_PATTERN)
_ENTITY_RAW = f"replace(replace(lower(coalesce(nullif(regexp_extract(content, {_ENT}, 1), ''), nullif(regexp_extract(content, {_ENT}, 2), ''))), '-', '_'), ' ', '_')"
_ENTITY = f"CASE {_ENTITY_RAW} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in sm.ENTITY_ALIASES.items()) + f" ELSE {_ENTITY_RAW} END"
define("raw_effects", "\nUNION ALL ".join(
    f"""SELECT repo_id, path, {i} AS pos, {"CASE WHEN svc IS NULL THEN 'external_api' ELSE concat('external_api:', svc) END" if e == 'external_api'
        else f"CASE WHEN ent IS NULL THEN '{e}' ELSE concat('{e}:', ent) END" if e.startswith('db_') else f"'{e}'"} AS type,
        CASE WHEN contains(content, '->') THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence, 'regex' AS source
        FROM {{effect_inputs}} WHERE regexp_matches(content, {q('(?i)' + p)})""" for i, (e, p) in enumerate(sm.EFFECT_PATTERNS.items())))
define("effect_inputs", f"""
SELECT f.repo_id, f.path, f.content, {_ENTITY.replace('content', 'f.content')} AS ent, i.sources,
  flatten(list_transform(coalesce(i.sources, []), lambda s: list_filter({_services(sm.API_SERVICES)}, lambda v: contains(lower(s), v))))[1] AS svc
FROM {{code_files}} f LEFT JOIN {{file_imports}} i ON i.repo_id = f.repo_id AND i.path = f.path""")
define("import_effects", f"""
SELECT repo_id, path, 100 + min(pos) AS pos, concat('external_api:', svc) AS type, 0.6::DOUBLE AS confidence, 'import_inference' AS source FROM (
  SELECT i.repo_id, i.path, s.n * 10 + v.n AS pos, {_services(sm.IMPORT_SERVICES)}[v.n] AS svc
  FROM {{file_imports}} i, unnest(range(1, len(i.sources) + 1)) s(n), unnest(range(1, {len(sm.IMPORT_SERVICES) + 1})) v(n)
  WHERE contains(lower(i.sources[s.n]), {_services(sm.IMPORT_SERVICES)}[v.n])) x
WHERE NOT EXISTS (SELECT 1 FROM {{raw_effects}} r WHERE r.repo_id = x.repo_id AND r.path = x.path AND contains(r.type, x.svc))
GROUP BY repo_id, path, svc""")
define("file_effects", "SELECT * FROM {raw_effects} UNION ALL SELECT * FROM {import_effects}")
define("file_effect_list", "SELECT repo_id, path, string_agg(type, '|' ORDER BY pos) AS effects FROM {file_effects} GROUP BY ALL")


def tagged(spark, sf):
    return st.file_semantics(ext(spark, sf))


def effect_rows(df):
    return xt.rows_of(df, "side_effects", "_pos", "e", "repo_id", "path").select("repo_id", "path", "e.type", "e.confidence", "e.source")


@query("c1_side_effects", "SELECT repo_id, path, string_split(type, ':')[1] AS family, confidence FROM {raw_effects}")
def c1(spark, sf):
    e = effect_rows(tagged(spark, sf)).where("source = 'regex'")
    return e.select("repo_id", "path", F.element_at(F.split("type", ":"), 1).alias("family"), "confidence")


@query("c2_entities", "SELECT repo_id, path, type FROM {raw_effects}")
def c2(spark, sf):
    return effect_rows(tagged(spark, sf)).where("source = 'regex'").select("repo_id", "path", "type")


@query("c3_import_services", "SELECT repo_id, path, type, confidence FROM {import_effects}")
def c3(spark, sf):
    return effect_rows(tagged(spark, sf)).where("source = 'import_inference'").select("repo_id", "path", "type", "confidence")


_FLOW = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(content, {q(p)}) THEN '{n}' END" for n, p in sm.CONTROL_PATTERNS.items()) + "], lambda x: x IS NOT NULL), '|')"


@query("c4_control_flow", f"""
SELECT repo_id, path, {_FLOW} AS control_flow FROM {{code_files}} UNION ALL SELECT repo_id, path, {_FLOW} FROM {{page_files}}""")
def c4(spark, sf):
    cols = ["repo_id", "path", "content"]
    both = code_files(spark, sf).select(cols).unionByName(view(spark, sf, "page_files").select(cols))
    return out(both.select("repo_id", "path", st.control_flow(F.col("content")).alias("control_flow")))


def domain_sql(label, text):
    scores = {d: "(" + " + ".join(f"10 * contains({label}, '{w}')::INT + 3 * contains({text}, '{w}')::INT" for w in ws) + ")" for d, ws in sm.DOMAIN_KEYWORDS.items()}
    return "[" + ", ".join(scores.values()) + "]"


_DOMAINS = "[" + ", ".join(q(d) for d in sm.DOMAIN_KEYWORDS) + "]"


def pick_domain(scores):
    return f"CASE WHEN list_max({scores}) < 10 THEN '' ELSE {_DOMAINS}[list_position({scores}, list_max({scores}))] END"


_LABELED = """SELECT repo_id, path, string_split(path, '/')[-1] AS name, content FROM {code_files}
  UNION ALL SELECT repo_id, path, string_split(path, '/')[-1], content FROM {doc_files}"""


@query("c5_domains", f"""
SELECT repo_id, path, {pick_domain('scores')} AS domain FROM (
  SELECT repo_id, path, {domain_sql("lower(concat(name, ' ', path))", "lower(content)")} AS scores FROM ({_LABELED}) x) y""")
def c5(spark, sf):
    cols = ["repo_id", "path", "content"]
    both = code_files(spark, sf).select(cols).unionByName(view(spark, sf, "doc_files").select(cols))
    named = both.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return st.with_domain(named, "name", "path", "content", "domain").select("repo_id", "path", "domain")


def role_sql(label):
    return "CASE " + " ".join(f"WHEN regexp_matches({label}, '(?i){p}') THEN '{r}'" for r, p in sm.ROLE_PATTERNS.items()) + " ELSE '' END"


@query("c6_roles", f"SELECT repo_id, path, {role_sql('path')} AS role FROM {{all_paths}}")
def c6(spark, sf):
    from .q_scan import all_paths
    return all_paths(spark, sf).select("repo_id", "path", st.role_of(F.lit(""), F.col("path")).alias("role"))


# ---- D -----------------------------------------------------------------------

define("scored_inputs", """
SELECT repo_id, path, '' AS name, -1 AS seq, language, content AS source, (length(content) - length(replace(content, chr(10), '')) + 1) AS n FROM {code_files}
UNION ALL SELECT repo_id, path, name, seq, language, source, line_end - line_start + 1 FROM {o_sources}
UNION ALL SELECT repo_id, path, '', -1, 'html', content, (length(content) - length(replace(content, chr(10), '')) + 1) FROM {page_files}""")


def scored_inputs(spark, sf):
    e = ext(spark, sf)
    files = e.select("repo_id", "path", F.lit("").alias("name"), F.lit(-1).alias("seq"), "language", F.col("content").alias("source"),
                     xt.line_count(F.col("content")).alias("n"))
    syms = xt.sources(e, "language").select("repo_id", "path", "name", "seq", "language", "source", (F.col("line_end") - F.col("line_start") + 1).alias("n"))
    pages = view(spark, sf, "page_files").select("repo_id", "path", F.lit("").alias("name"), F.lit(-1).alias("seq"), F.lit("html").alias("language"),
                                                 F.col("content").alias("source"), xt.line_count(F.col("content")).alias("n"))
    return files.unionByName(syms).unionByName(pages)


def _n(pattern):
    return f"len(regexp_extract_all(source, {q(pattern)}))"


def src():
    return F.col("source")


def lang():
    return F.col("language")


BRANCH_SQL = "CASE language " + " ".join(f"WHEN '{lang}' THEN {_n(p)}" for lang, p in cx.BRANCHES.items()) + f" ELSE {_n(cx.BRANCHES['python'])} END"
define("char_depth", """
SELECT repo_id, path, seq, max(depth - least(0, low)) AS deepest FROM (
  SELECT *, min(depth) OVER (PARTITION BY repo_id, path, seq ORDER BY i ROWS UNBOUNDED PRECEDING) AS low FROM (
    SELECT *, sum(CASE ch WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY repo_id, path, seq ORDER BY i ROWS UNBOUNDED PRECEDING) AS depth FROM (
      SELECT repo_id, path, seq, c.i, substring(marks, c.i, 1) AS ch FROM (
        SELECT repo_id, path, seq, regexp_replace(source, '[^{}]', '', 'g') AS marks FROM {scored_inputs} WHERE language <> 'python') m, unnest(range(1, length(marks) + 1)) c(i)) d) e) f
GROUP BY ALL""")
define("nesting", r"""
SELECT s.*, CASE WHEN s.language = 'python' THEN coalesce(list_max(list_transform(regexp_extract_all(s.source, '(?m)^( +)\S', 1), lambda x: length(x))), 0) // 4
  ELSE coalesce(greatest(d.deepest, 0), 0) END::BIGINT AS depth
FROM {scored_inputs} s LEFT JOIN {char_depth} d ON d.repo_id = s.repo_id AND d.path = s.path AND d.seq = s.seq""")
REC_SQL = (f"CASE WHEN len(list_filter(regexp_extract_all(source, {q(cx.DEFINED_NAME)}, 1), lambda x: regexp_matches(substring(source, strpos(source, x) + length(x)), "
           f"concat('\\b', x, '\\s*\\(')))) > 0 THEN 2.0 ELSE 0.0 END")
CALLBACK_SQL = f"CASE WHEN language IN ('javascript', 'typescript') THEN greatest({_n(cx.CALLBACK)} - 2, 0) * 1.5 ELSE 0 END"
FW_SQL = " + ".join(f"CASE WHEN regexp_matches(source, {q('(?i)' + h)}) THEN {' + '.join(f'{_n(p)} * {w}::DOUBLE' for p, w in cx.FRAMEWORKS[fw])} ELSE 0 END" for fw, h in cx.HINTS.items())


def _widest(p):
    return f"coalesce(list_max(list_transform(regexp_extract_all(source, {q(p)}, 1), lambda g: len(list_filter(string_split(g, ','), lambda x: trim(x) <> '')))), 0)"


PARAM_SQL = (f"CASE WHEN language = 'python' THEN {_widest(cx.PYTHON_SIGNATURE)} WHEN language IN ({', '.join(q(v) for v in cx.TYPED_LANGUAGES)}) "
             f"THEN {_widest(cx.TYPED_SIGNATURE)} ELSE {_widest(cx.OTHER_SIGNATURE)} END")
define("scored", f"""
SELECT repo_id, path, name, seq::BIGINT AS seq, language, n, depth, source,
  ({BRANCH_SQL})::DOUBLE AS branches, pow(depth, 1.5)::DOUBLE AS nesting, (log2(greatest(n, 1)) * 0.8)::DOUBLE AS size, ({REC_SQL})::DOUBLE AS recursion,
  ({CALLBACK_SQL})::DOUBLE AS callbacks, ({_n(cx.TERNARY)} * 0.5)::DOUBLE AS ternaries, ({FW_SQL})::DOUBLE AS frameworks, (greatest({PARAM_SQL} - 3, 0) * 0.8)::DOUBLE AS params
FROM {{nesting}}""")
BUCKET_SQL = """CASE WHEN source = '' THEN CASE WHEN n <= 30 THEN 'simple' WHEN n <= 150 THEN 'moderate' ELSE 'complex' END
  WHEN branches + nesting + size + recursion + callbacks + ternaries + frameworks + params <= 8 THEN 'simple'
  WHEN branches + nesting + size + recursion + callbacks + ternaries + frameworks + params <= 22 THEN 'moderate' ELSE 'complex' END"""


def _term(name, key, expr, extra=()):
    @query(name, f"SELECT repo_id, path, seq, round({key}, 6) AS {key} FROM {{scored}}")
    def run(spark, sf):
        return out(scored_inputs(spark, sf).select("repo_id", "path", "seq", F.round(expr(), 6).alias(key)))
    return run


_term("d1_branches", "branches", lambda: cp.branches(src(), lang()).cast("double"))
_term("d2_nesting", "nesting", lambda: cp.nesting_term(cp.nesting(src(), lang())))
_term("d3_size", "size", lambda: cp.size_term(F.col("n")))
_term("d4_recursion", "recursion", lambda: cp.recursion_term(src()))
_term("d5_callbacks", "callbacks", lambda: cp.callback_term(src(), lang()).cast("double"))
_term("d6_ternaries", "ternaries", lambda: cp.ternary_term(src()))
_term("d7_frameworks", "frameworks", lambda: cp.framework_term(src()))
_term("d8_params", "params", lambda: cp.param_term(cp.max_params(src(), lang())))


@query("d9_complexity", f"SELECT repo_id, path, seq, {BUCKET_SQL} AS complexity FROM {{scored}}")
def d9(spark, sf):
    return out(cp.with_complexity(scored_inputs(spark, sf), "source", "language", "n").select("repo_id", "path", "seq", "complexity"))


@query("d10_user_rules", "SELECT repo_id, path, seq, round(branches, 6) AS branches, round(frameworks, 6) AS frameworks FROM {user_scored}")
def d10(spark, sf):
    rules = cx.DEFAULT_RULES.extend(branches={"go": r"return"}, hints={"repo_layer": r"repo\."}, frameworks={"repo_layer": [(r"\.save\(", 2.5)]})
    return out(scored_inputs(spark, sf).select("repo_id", "path", "seq", F.round(cp.branches(src(), lang(), rules).cast("double"), 6).alias("branches"),
                                               F.round(cp.framework_term(src(), rules), 6).alias("frameworks")))


define("user_scored", f"""
SELECT repo_id, path, seq, CASE WHEN language = 'go' THEN {_n('return')} ELSE branches END::DOUBLE AS branches,
  frameworks + CASE WHEN regexp_matches(source, '(?i)repo\\.') THEN {_n(chr(92) + '.save' + chr(92) + '(')} * 2.5 ELSE 0 END AS frameworks FROM {{scored}}""")

# ---- symbols with inherited tags (C7, C8) -------------------------------------

define("o_units", f"""
SELECT s.*, coalesce(e.effects, '') AS effects, fl.control_flow, {pick_domain('scores')} AS domain, {role_sql("concat(s.name, ' ', s.path)")} AS role, c.complexity
FROM (SELECT *, {domain_sql("lower(concat(name, ' ', path))", "lower(source)")} AS scores FROM {{o_sources}}) s
LEFT JOIN {{file_effect_list}} e ON e.repo_id = s.repo_id AND e.path = s.path
JOIN (SELECT repo_id, path, {_FLOW} AS control_flow FROM {{code_files}}) fl ON fl.repo_id = s.repo_id AND fl.path = s.path
JOIN (SELECT repo_id, path, seq, {BUCKET_SQL} AS complexity FROM {{scored}}) c ON c.repo_id = s.repo_id AND c.path = s.path AND c.seq = s.seq""")


def units(spark, sf, only=None):
    return build.units(code_files(spark, sf), only=only)


@query("c7_symbol_tags", "SELECT repo_id, path, name, seq + 1 AS seq, effects, control_flow, domain, role FROM {o_units}")
def c7(spark, sf):
    u = units(spark, sf).where("kind <> 'file'")
    return out(u.select("repo_id", "path", "name", "seq", F.transform("side_effects", lambda e: e["type"]).alias("effects"), "control_flow", "domain", "role"))


define("o_summaries", """
SELECT *, concat_ws(' · ', CASE WHEN kind = 'function' THEN concat('Function', CASE WHEN params <> '' THEN concat(' (', array_to_string(string_split(params, '|')[1:5], ', '), ')') ELSE '' END)
    ELSE concat('Class with ', CASE WHEN methods = '' THEN 0 ELSE len(string_split(methods, '|')) END, ' methods', CASE WHEN bases <> '' THEN concat(', extends ', replace(bases, '|', ', ')) ELSE '' END) END,
  nullif(role, ''), CASE WHEN domain <> '' THEN concat('[', domain, ']') END,
  CASE WHEN effects <> '' THEN concat('→ ', array_to_string(string_split(effects, '|')[1:3], ', ')) END) AS summary FROM {o_units}""")


@query("c8_summaries", """
SELECT repo_id, path, seq + 1 AS seq, summary FROM {o_summaries}
UNION ALL SELECT repo_id, path, 0, concat(language, ' file (', length(content) - length(replace(content, chr(10), '')) + 1, ' lines)') FROM {code_files}""")
def c8(spark, sf):
    return out(units(spark, sf).select("repo_id", "path", "seq", "summary"))


