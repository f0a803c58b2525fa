"""Test inputs derived from the given tables: one SQL text per view, valid in both engines."""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusgraph.functions.tables import written

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _lines(*lines):
    """SQL for text lines joined with a newline; ``<k+n>`` is arithmetic on k.

    Quotes, braces and backslashes are built with chr() so both engines read the same text.
    """
    codes = {"'": 39, "{": 123, "}": 125, "\\": 92}
    out = []
    for line in lines:
        for piece in re.split(r"(<k[+-]\d+>|<k>|['{}\\])", line):
            if not piece:
                continue
            if piece in codes:
                out.append(f"chr({codes[piece]})")
            elif piece.startswith("<k"):
                out.append(f"CAST({piece[1:-1]} AS STRING)")
            else:
                out.append(f"'{piece}'")
        out.append("chr(10)")
    return "concat(" + ", ".join(out) + ")"


_PY = _lines("import f<k+13>", "", "def fn_<k>(self, a, b):", "    if a:", "        repo.save(a)",
             "    return fn_<k+5>(b)", "", "class C<k>(C<k+1>):", "    def go_<k>(self):", "        return fn_<k+9>(1)")
_JS = _lines("import { x } from './f<k+13>'", "export function fn_<k>(a, b) {", "  if (a) { axios.post(a) }",
             "  return fn_<k+5>(b)", "}", "export class C<k> extends C<k+1> {", "  x() { return 1 }", "}")
_PHP = _lines("<?php", "use App\\f<k+13>;", "class C<k> extends C<k+1> {", "  public function fn_<k>($a, $b) {",
              "    if ($a) { Order::create($a); }", "    return fn_<k+5>($b);", "  }", "}")
_GO = _lines("package m", "import \"stripe/f<k+13>\"", "type C<k> struct {", "}", "func fn_<k>(a int, b int) int {",
             "  if a > 0 {", "    return fn_<k+5>(b)", "  }", "  return 0", "}")

# Seven more languages; strings and comments hold braces, and brackets nest deeply.
_MORE = {
    "typescript": ("ts", ["import { A<k>, B } from './m<k+3>'", "export interface I<k> {", "}", "export class T<k> extends T<k+1> {", "  run() { return `{<k>` } // }", "}",
                          "export async function load_<k>(a: string, b: number) {", "  const s = '}' /* { */", "  return call_<k+2>(s)", "}", "const pick_<k> = (x) => x + 1", "export { load_<k> as main }"]),
    "java": ("java", ["import org.app<k>.Base;", "public class J<k> extends J<k+1> {", "    /* } */ private String s = \"{\";", "    public static int sum_<k>(int a, String b) {", "        if (a > 0) { return b.length(); }",
                      "        return get_<k+5>(a);", "    }", "}"]),
    "rust": ("rs", ["use crate::m<k>;", "pub struct R<k>;", "pub trait Q<k> {", "}", "pub fn calc_<k>(a: i32, s: &str) -> i32 {", "    let t = \"}\"; // {", "    a + next_<k+1>(s)", "}"]),
    "ruby": ("rb", ["require 'lib<k>'", "class U<k> < U<k+1>", "  def go_<k>(a, b)", "    step_<k+2>(a)", "  end", "end"]),
    "csharp": ("cs", ["using App.N<k>;", "public class S<k> : S<k+1> {", "    // one }", "    public async Task Do_<k>(int a) {", "        var p = \"}\";", "        await Call_<k+3>(a);", "    }", "}"]),
    "kotlin": ("kt", ["import app.n<k>", "class K<k>(val x: Int)", "fun one_<k>(a: Int) = two_<k+1>(a)", "fun two_<k>(b: Int): Int {", "    val s = \"{\"", "    return b", "}"]),
    "swift": ("swift", ["import Kit<k>", "class W<k>: Base {", "    func act_<k>(a: Int) {", "        print(\"}\")", "    }", "}"]),
}


def _repeated(lines: list, times: int) -> str:
    """The lines several times over, each time with numbers of its own: files of some KB."""
    parts = [_lines(*[re.sub(r"<k([+-]\d+)?>", lambda m: f"<k+{1000 * t + int(m[1] or 0)}>", line) for line in lines]) for t in range(times)]
    return "concat(" + ", ".join(parts) + ")"


SHARED = {}
SHARED["more_files"] = "\nUNION ALL ".join(f"""
SELECT 'more' AS repo_id, concat('{lang}/f', CAST(k AS STRING), '.{end}') AS path, '{lang}' AS language, k, {_repeated(lines, 10)} AS content
FROM (SELECT s_suppkey AS k FROM {{supplier}}) s""" for lang, (end, lines) in _MORE.items())
SHARED["code_files"] = f"""
SELECT repo_id, concat(d, '/', m, '/', file_name) AS path, file_name, CAST(length(content) AS BIGINT) AS length,
       mtime, content, language, k
FROM (
  SELECT concat('r', CAST(o_custkey % 20 AS STRING)) AS repo_id, k, o_orderdate AS mtime,
    CASE k % 8 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 2 THEN 'model' WHEN 3 THEN 'component'
               WHEN 4 THEN 'util' WHEN 5 THEN 'test' WHEN 6 THEN 'docs' ELSE 'src' END AS d,
    CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'payment' WHEN '2' THEN 'auth' WHEN '3' THEN 'user'
               WHEN '4' THEN 'search' ELSE 'email' END AS m,
    concat('f', CAST(k AS STRING), CASE k % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.php' ELSE '.go' END) AS file_name,
    CASE k % 4 WHEN 0 THEN {_PY} WHEN 1 THEN {_JS} WHEN 2 THEN {_PHP} ELSE {_GO} END AS content,
    CASE k % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'php' ELSE 'go' END AS language
  FROM (SELECT o_orderkey AS k, o_custkey, o_orderdate, o_orderpriority FROM {{orders}}) o
) f
"""

SHARED["noise_files"] = """
SELECT concat('r', CAST(p_partkey % 20 AS STRING)) AS repo_id,
  CASE p_partkey % 8 WHEN 0 THEN concat('node_modules/p', k, '/index.js') WHEN 1 THEN concat('.git/objects/o', k, '.py')
    WHEN 2 THEN concat('web/lib', k, '.min.js') WHEN 3 THEN concat('img/pic', k, '.PNG')
    WHEN 4 THEN concat('data/blob', k, '.weird') WHEN 5 THEN concat('src/.hidden', k, '.py')
    WHEN 6 THEN concat('src/f', k, '.tmp.py') ELSE concat('docker', k, '/Dockerfile') END AS path,
  CAST(p_partkey * 600 AS BIGINT) AS length
FROM (SELECT p_partkey, CAST(p_partkey AS STRING) AS k FROM {part}) p
"""

SHARED["globs"] = """
SELECT concat('r', CAST(n_nationkey % 20 AS STRING)) AS repo_id,
  CASE n_nationkey % 5 WHEN 0 THEN '*.tmp.py' WHEN 1 THEN 'docs/*' WHEN 2 THEN 'f1?.py' WHEN 3 THEN 'email/' ELSE 'util/user/f[0-4]*' END AS glob
FROM {nation}
"""

SHARED["page_files"] = """
SELECT 'pages' AS repo_id, CASE WHEN regexp_replace(p, '[.][a-z]+$', '') <> p THEN p ELSE concat(p, '.html') END AS path, page_id,
       html AS content, CAST(length(html) AS BIGINT) AS length
FROM (SELECT page_id, html, concat(CAST(page_id % 7 AS STRING), '/', CAST(page_id AS STRING), '/', regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')) AS p FROM {pages}) x
"""

SHARED["doc_files"] = """
SELECT 'docs' AS repo_id, concat(source, '/', lang, '/d', CAST(doc_id AS STRING), '.md') AS path, doc_id, text AS content
FROM {documents}
"""

_KEYED = """CASE k % 6 WHEN 0 THEN 'entry_point' WHEN 1 THEN 'orchestrator' WHEN 2 THEN 'validator' WHEN 3 THEN 'data_access' WHEN 4 THEN 'adapter' ELSE '' END AS role,
  CASE k % 4 WHEN 0 THEN 'db_write:orders' WHEN 1 THEN 'external_api:stripe' WHEN 2 THEN 'db_write:orders,external_api:stripe' ELSE '' END AS effects_text,
  CASE k % 3 WHEN 0 THEN 'branching' WHEN 1 THEN 'branching,loop' ELSE '' END AS flow_text,
  CASE k % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'complex' END AS complexity,
  CASE k % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'php' END AS language,
  CAST(1 + k % 50 AS INT) AS line_start, CAST(1 + k % 50 + k % 400 AS INT) AS line_end"""

SHARED["star_nodes"] = f"""
SELECT 'star' AS repo_id, concat(letter, CAST(k AS STRING)) AS id, type, name, file_path, domain, {_KEYED},
  CASE WHEN k % 5 = 0 THEN CASE type WHEN 'function' THEN 'Function (a, b)' WHEN 'class' THEN 'Class with 2 methods' ELSE 'python file (10 lines)' END
       ELSE concat('Handles ', name) END AS summary,
  concat(CAST(kind AS STRING), lpad(CAST(k AS STRING), 12, '0')) AS ord, k
FROM (
  SELECT 'R' AS letter, 0 AS kind, r_regionkey AS k, 'file' AS type, r_name AS name, concat(r_name, '/all/docs/', r_name) AS file_path, '' AS domain FROM {{region}}
  UNION ALL SELECT 'N', 1, n_nationkey, 'file', n_name, concat(r_name, '/', n_name, '/config/', n_name), '' FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
  UNION ALL SELECT 'C', 2, c_custkey, 'class', c_name, concat(r_name, '/', n_name, '/controller/', c_name), lower(c_mktsegment)
    FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
  UNION ALL SELECT 'S', 3, s_suppkey, 'class', s_name, concat(r_name, '/', n_name, '/repository/', s_name), ''
    FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
  UNION ALL SELECT 'P', 4, p_partkey, 'function', p_name, concat(r_name, '/', n_name, '/util/', p_name), lower(p_type)
    FROM {{part}} JOIN {{nation}} ON p_partkey % 25 = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
  UNION ALL SELECT 'O', 5, o_orderkey, 'function', concat('order_', CAST(o_orderkey AS STRING)), concat(r_name, '/', n_name, '/service/order_', CAST(o_orderkey AS STRING)), ''
    FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
) n
"""

SHARED["star_edges"] = """
SELECT 'star' AS repo_id, src, dst, type, CASE type WHEN 'contains' THEN 0.5e0 WHEN 'imports' THEN 0.6e0 ELSE 0.4e0 END AS weight
FROM (
  SELECT concat('R', CAST(n_regionkey AS STRING)) AS src, concat('N', CAST(n_nationkey AS STRING)) AS dst, 'contains' AS type FROM {nation}
  UNION ALL SELECT concat('N', CAST(c_nationkey AS STRING)), concat('C', CAST(c_custkey AS STRING)), 'contains' FROM {customer}
  UNION ALL SELECT concat('N', CAST(s_nationkey AS STRING)), concat('S', CAST(s_suppkey AS STRING)), 'contains' FROM {supplier}
  UNION ALL SELECT concat('C', CAST(o_custkey AS STRING)), concat('O', CAST(o_orderkey AS STRING)), 'calls' FROM {orders}
  UNION ALL SELECT DISTINCT concat('O', CAST(l_orderkey AS STRING)), concat('P', CAST(l_partkey AS STRING)), 'calls' FROM {lineitem}
  UNION ALL SELECT DISTINCT concat('P', CAST(l_partkey AS STRING)), concat('S', CAST(l_suppkey AS STRING)), 'calls' FROM {lineitem}
  UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), concat('N', CAST(nxt AS STRING)), 'imports'
    FROM (SELECT n_nationkey, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nxt FROM {nation}) x WHERE nxt IS NOT NULL
) e
"""

SHARED["snap_new"] = """
SELECT 'ev' AS repo_id, concat('u', CAST(user_id AS STRING), '.py') AS path,
       concat(CAST(max(event_id) AS STRING), ':', CAST(max(value) AS STRING)) AS fp
FROM {events} WHERE user_id % 11 <> 0 GROUP BY user_id
"""
SHARED["snap_old"] = """
SELECT 'ev' AS repo_id, concat('u', CAST(user_id AS STRING), '.py') AS path,
       concat(CAST(max(event_id) AS STRING), ':', CAST(max(value) AS STRING)) AS fp
FROM {events} WHERE user_id % 13 <> 0 AND (event_type <> 'click' OR user_id % 3 = 0) GROUP BY user_id
"""

SHARED["changes"] = """
SELECT repo_id, path, CASE WHEN k % 3 = 0 THEN 'staged' ELSE 'unstaged' END AS kind, 'HEAD' AS ref FROM {code_files} WHERE k % 500 = 0
UNION ALL SELECT repo_id, path, 'staged', 'HEAD' FROM {code_files} WHERE k % 1000 = 0
UNION ALL SELECT 'r1', concat('gone/x', CAST(r_regionkey AS STRING), '.py'), 'staged', 'HEAD' FROM {region}
UNION ALL SELECT repo_id, path, 'committed', 'HEAD~3' FROM {code_files} WHERE k % 700 = 0
"""

SHARED["star_changes"] = """
SELECT repo_id, file_path AS path FROM {star_nodes} WHERE type = 'file' AND k % 7 = 3
UNION ALL SELECT 'star', concat('gone/x', CAST(r_regionkey AS STRING)) FROM {region}
"""

SHARED["questions"] = """
SELECT concat('p', CAST(p_partkey AS STRING)) AS question_id, concat('Which ', p_name, ' fails for economy db_write') AS question FROM {part} WHERE p_partkey % 50 = 0
UNION ALL SELECT concat('c', CAST(conv_id AS STRING)), text FROM {conversations} WHERE turn = 0 AND role = 'user'
"""

SHARED["golden"] = """
SELECT repo_id, name, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'db_write' ELSE 'external_api,db_write' END AS expected_effects,
  CASE WHEN k % 4 = 0 THEN 'branching' ELSE 'branching,loop' END AS expected_control,
  CASE WHEN k % 2 = 0 THEN role ELSE 'adapter' END AS expected_role,
  k % 5 <> 1 AS has_effects, k % 5 <> 2 AS has_control, k % 5 <> 3 AS has_role
FROM {star_nodes} WHERE type = 'class'
UNION ALL SELECT 'star', concat('missing_', CAST(r_regionkey AS STRING)), '', '', 'adapter', true, false, true FROM {region}
"""


def _q(s):
    return s.replace("'", "''")


def _manifest_text():
    """Manifest text per supplier key; the same kinds the inventory reads."""
    kinds = [
        ("composer.json", ['{"require": {"php": "8.<v>", "laravel/framework": "^<v>.0", "ext-json": "*", "acme/pkg<v>": "1.<v>"}, "require-dev": {"phpunit/phpunit": "9.<v>"}}']),
        ("package.json", ['{"engines": {"node": ">=<v>", "npm": "9"}, "dependencies": {"react": "18.<v>", "lib<v>": "1.0"}, "devDependencies": {"vue": "3.<v>"}}']),
        ("requirements.txt", ["# comment", "numpy==1.<v>", "pandas>=2.<v>", "flask", "", "requests~=2.<v>"]),
        ("go.mod", ["module m", "go 1.<v>", "require (", "\tgithub.com/a/b<v> v1.<v>.0", "\tgolang.org/x/net v0.<v>.1", ")"]),
        ("Gemfile", ["ruby '3.<v>.0'", "gem 'rails', '~> 7.<v>'", "gem 'puma'", "gem 'pg', '1.<v>'"]),
        ("Dockerfile", ["FROM $BASE AS b", "FROM php8<v>-fpm:1.<v>", "RUN x"]),
        ("pyproject.toml", ["[project]", "requires-python = \">=3.<v>\""]),
    ]
    cases, names = [], []
    for i, (name, lines) in enumerate(kinds):
        out = []
        for j, line in enumerate(lines):
            for piece in re.split(r"(<v>|['{}\\\t])", line):
                if piece == "<v>":
                    out.append("CAST(k % 10 AS STRING)")
                elif piece in ("'", "{", "}", "\\", "\t"):
                    out.append(f"chr({ord(piece)})")
                elif piece:
                    out.append(f"'{piece}'")
            if j < len(lines) - 1:
                out.append("chr(10)")
        cases.append(f"WHEN {i} THEN concat({', '.join(out)})")
        names.append(f"WHEN {i} THEN '{name}'")
    return "CASE kind " + " ".join(cases) + " END", "CASE kind " + " ".join(names) + " END"


_TEXT, _NAME = _manifest_text()
SHARED["manifests"] = f"""
SELECT concat('m', CAST(k % 40 AS STRING)) AS repo_id,
  concat(CASE k % 9 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/' WHEN 2 THEN 'a/deep/' WHEN 3 THEN 'vendor/' WHEN 4 THEN '.hid/' ELSE '' END, {_NAME}) AS path,
  {_TEXT} AS content, k
FROM (SELECT s_suppkey AS k, CAST((s_suppkey + s_nationkey) % 7 AS INT) AS kind FROM {{supplier}}) s
"""


def refs(sql: str, known) -> list:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n in known]


_DISTINCT_NAMES = re.compile(r"SELECT DISTINCT (concat\('\w', CAST\((\w+) AS STRING\)\), concat\('\w', CAST\((\w+) AS STRING\)\)), 'calls' FROM (\{lineitem\})")


def on_keys(text: str) -> str:
    """Names made of a letter and a key are distinct where the keys are: keys are exchanged, which are shorter."""
    return _DISTINCT_NAMES.sub(r"SELECT \1, 'calls' FROM (SELECT DISTINCT \2, \3 FROM \4) d", text)


#: Files of one split of the code corpus, at most.
SPLIT = 20_000


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, or a view over given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    if name == "code_files":
        # One small input file is one task; a real corpus arrives in many splits, and in more of them the larger it is.
        orders = view(spark, sf, "orders")
        orders = orders.repartition(max(spark.sparkContext.defaultParallelism, -(-orders.count() // SPLIT)))
        return spark.sql(SHARED[name], orders=orders)
    text = on_keys(SHARED[name])
    inputs = {n: view(spark, sf, n) for n in refs(text, set(TABLES) | set(SHARED))}
    return spark.sql(text, **inputs)


def code_files(spark, sf):
    return view(spark, sf, "code_files").drop("k")


def star_nodes(spark, sf):
    """Star nodes in the canonical nested layout."""
    def parts(c):
        return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))

    effects = F.transform(parts("effects_text"), lambda e: F.struct(
        e.alias("type"), F.lit(0.7).alias("confidence"), F.lit("regex").alias("source")))
    v = view(spark, sf, "star_nodes")
    return v.select(
        "repo_id", "id", "type", "name", "file_path",
        F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end")).alias("line_range"),
        "summary", F.array("language").alias("tags"), "language", "complexity",
        F.struct(effects.alias("side_effects"), parts("flow_text").alias("control_flow"), F.col("domain").alias("domain_hint"),
                 F.col("role").alias("execution_role"), F.lit(0.0).alias("importance")).alias("semantics"),
        "ord")


def star_edges(spark, sf):
    return view(spark, sf, "star_edges")


def out(df: DataFrame) -> DataFrame:
    """Plain result types: integers as bigint, arrays as text."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        c = F.col(f.name)
        if t in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif t == "array<string>":
            c = F.array_join(c, "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


_STORED = {}


def stored(spark, sf, name, build):
    """A derived table written once per session, as a real graph would be stored."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = written(build(), name, compression="zstd")
    return _STORED[key]
