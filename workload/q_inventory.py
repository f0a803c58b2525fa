"""Version inventory, retrieval and explorer queries (inventory groups L and M)."""

from pyspark.sql import functions as F

from corpusgraph.operators import explore as xo, inventory as inv
from corpusgraph.rules import inventory as iv

from .q_extract import q
from .q_graph import edges, nodes
from .registry import query
from .sqlbook import define
from .views import out, view

# ---- L --------------------------------------------------------------------------


def manifests(spark, sf):
    return view(spark, sf, "manifests").drop("k")


define("man", f"""
SELECT repo_id, folder, file_name, max(content) AS content, CASE WHEN starts_with(max(content), '{{') THEN max(content) ELSE '{{}}' END AS jc FROM (SELECT *, string_split(path, '/')[-1] AS file_name, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END AS folder FROM {{manifests}}) m
WHERE len(string_split(path, '/')) <= 2 AND NOT starts_with(folder, '.') AND folder NOT IN ('vendor', 'node_modules', '.git') GROUP BY ALL""")


def _j(path):
    return f"json_extract_string(jc, '{path}')"


def _cand(kind, where, section, name, value, last=True, sub=0):
    return f"SELECT repo_id, folder, '{kind}' AS kind, '{section}' AS section, '{name}' AS name, {value} AS version, {str(last).lower()} AS last, {sub} AS sub FROM {{man}} m WHERE file_name = '{where}'"


_rows = [_cand("php", "composer.json", "runtime", "php", _j("$.require.php"))]
_rows += [_cand("php", "composer.json", "frameworks", fw, _j(f'$.require."{p}"'), sub=i) for i, (p, fw) in enumerate(iv.PHP_FRAMEWORKS.items())]
_rows += [_cand("node", "package.json", "runtime", "node", _j("$.engines.node"), last=False), _cand("node", "package.json", "runtime", "npm", _j("$.engines.npm"))]
_rows += [_cand("node", "package.json", "frameworks", fw, "coalesce(" + _j(f'$.devDependencies."{p}"') + ", " + _j(f'$.dependencies."{p}"') + ")") for p, fw in iv.NODE_FRAMEWORKS.items()]
_rows += [_cand("python", "pyproject.toml", "runtime", "python", "nullif(regexp_extract(content, 'requires-python\\s*=\\s*[\"'']([^\"'']+)', 1), '')")]
_rows += [_cand("go", "go.mod", "runtime", "go", "nullif(regexp_extract(content, '(?m)^go\\s+([\\d.]+)', 1), '')")]
_rows += [_cand("ruby", "Gemfile", "runtime", "ruby", "nullif(regexp_extract(content, 'ruby\\s+[''\"]([^''\"]+)', 1), '')", last=False)]
_rows += [_cand("ruby", "Gemfile", "frameworks", fw, f"CASE WHEN regexp_matches(content, 'gem ''{g}''') THEN coalesce(nullif(regexp_extract(content, 'gem ''{g}'', ''([^'']*)''', 1), ''), '*') END") for g, fw in iv.RUBY_FRAMEWORKS.items()]
_rows += [_cand("docker", "Dockerfile", "runtime", "docker_base", "list_filter(regexp_extract_all(content, 'FROM\\s+([^\\s]+)', 1), lambda x: NOT starts_with(x, '$'))[1]", last=False)]
define("cands", "SELECT * FROM (" + "\nUNION ALL ".join(_rows) + """
UNION ALL SELECT c.repo_id, c.folder, 'php', 'runtime', 'php', regexp_replace(nullif(regexp_extract(d.content, '(?i)php(\\d+)[.\\-]', 1), ''), '^(\\d)(\\d+)$', '\\1.\\2'), false, 0
  FROM {man} c JOIN {man} d ON d.repo_id = c.repo_id AND d.folder = c.folder AND d.file_name = 'Dockerfile' WHERE c.file_name = 'composer.json' AND json_extract_string(c.jc, '$.require.php') IS NULL) x WHERE version IS NOT NULL""")
define("settled", """
SELECT repo_id, section, name, coalesce(arg_max(version, folder || sub) FILTER (last), arg_min(version, folder) FILTER (NOT last)) AS version, min(kind) AS kind FROM {cands} GROUP BY repo_id, section, name""")


def _versions(name, kind):
    @query(name, f"SELECT repo_id, section, name, version FROM {{settled}} WHERE kind = '{kind}'")
    def run(spark, sf):
        return inv.settled_versions(inv.candidates(manifests(spark, sf), (kind,)))
    return run


_versions("l1_php", "php")
_versions("l2_node", "node")
_versions("l3_python", "python")
_versions("l4_go", "go")
_versions("l5_ruby", "ruby")
_versions("l6_docker", "docker")

_ENTRY = "list_transform({0}, lambda e: concat(e.name, '=', e.version))"
define("packs", """
SELECT repo_id, folder, 'composer' AS manager, len(ks)::BIGINT AS count, array_to_string(list_transform(ks, lambda k: concat(k, '=', coalesce(json_extract_string(jc, concat('$."require-dev"."', k, '"')), json_extract_string(jc, concat('$.require."', k, '"'))))), ',') AS key
FROM (SELECT *, list_filter(list_concat(json_keys(jc, '$.require'), json_keys(jc, '$."require-dev"')), lambda k: k <> 'php' AND NOT starts_with(k, 'ext-')) AS ks FROM {man} WHERE file_name = 'composer.json') a
UNION ALL SELECT repo_id, folder, 'npm', (len(json_keys(jc, '$.dependencies')) + len(json_keys(jc, '$.devDependencies')))::BIGINT,
  array_to_string(list_transform(json_keys(jc, '$.dependencies'), lambda k: concat(k, '=', json_extract_string(jc, concat('$.dependencies."', k, '"')))), ',') FROM {man} WHERE file_name = 'package.json'
UNION ALL SELECT repo_id, folder, 'pip', len(ls)::BIGINT, array_to_string(list_transform(ls, lambda l: concat(regexp_extract(l, '^([^=<>!~]*)', 1), '=', CASE WHEN regexp_matches(l, '[=<>!~]') THEN trim(l[length(regexp_extract(l, '^([^=<>!~]*)', 1)) + 1:], '=<>!~ ') ELSE '*' END)), ',')
  FROM (SELECT *, list_filter(string_split(content, chr(10)), lambda l: trim(l) <> '' AND NOT starts_with(l, '#')) AS ls FROM {man} WHERE file_name = 'requirements.txt') b
UNION ALL SELECT repo_id, folder, 'go', len(ms)::BIGINT, array_to_string(list_transform(ms, lambda m: regexp_replace(m, '^\\t([\\w./\\-]+)\\s+(v[\\d.]+)$', '\\1=\\2')), ',') FROM (SELECT *, regexp_extract_all(content, '(?m)^\\t([\\w./\\-]+)\\s+(v[\\d.]+)') AS ms FROM {man} WHERE file_name = 'go.mod') c
UNION ALL SELECT repo_id, folder, 'gem', len(ms)::BIGINT, array_to_string(list_transform(ms, lambda m: concat(regexp_extract(m, 'gem ''([^'']+)''', 1), '=', regexp_extract(m, 'gem ''[^'']+'', ''([^'']*)''', 1))), ',') FROM (SELECT *, regexp_extract_all(content, 'gem\\s+''[^'']+''(?:,\\s*''[^'']*'')?') AS ms FROM {man} WHERE file_name = 'Gemfile') d""")


@query("l7_precedence", "SELECT repo_id, section, name, version FROM {settled}")
def l7(spark, sf):
    return inv.settled_versions(inv.candidates(manifests(spark, sf)))


@query("l7_packages", "SELECT repo_id, manager, arg_max(count, folder) AS count, arg_max(key, folder) AS key FROM {packs} WHERE count > 0 GROUP BY repo_id, manager")
def l7_packages(spark, sf):
    p = inv.settled_packages(inv.candidates(manifests(spark, sf)))
    return out(p.select("repo_id", "manager", "count", F.array_join(F.transform("key", lambda e: F.concat(e["name"], F.lit("="), e["version"])), ",").alias("key")))


define("findings", """
SELECT DISTINCT repo_id, CASE k % 3 WHEN 0 THEN 'runtime' WHEN 1 THEN 'frameworks' ELSE 'tools' END AS section, CASE k % 3 WHEN 0 THEN 'PHP' WHEN 1 THEN 'react' ELSE 'go' END AS name, '0.1' AS version FROM {manifests}""")


@query("l8_gap_fill", """
SELECT repo_id, section, name, version FROM {settled} s WHERE NOT (section = 'runtime' AND name = 'go' AND repo_id IN (SELECT repo_id FROM {findings} WHERE section = 'tools'))
UNION ALL SELECT * FROM {findings} f WHERE section <> 'tools' AND NOT EXISTS (SELECT 1 FROM {settled} s WHERE s.repo_id = f.repo_id AND s.section = f.section AND lower(s.name) = lower(f.name))
UNION ALL SELECT repo_id, 'runtime', name, version FROM {findings} WHERE section = 'tools'""")
def l8(spark, sf):
    section = F.expr("case k % 3 when 0 then 'runtime' when 1 then 'frameworks' else 'tools' end")
    name = F.expr("case k % 3 when 0 then 'PHP' when 1 then 'react' else 'go' end")
    findings = view(spark, sf, "manifests").select("repo_id", section.alias("section"), name.alias("name"), F.lit("0.1").alias("version")).distinct()
    return inv.with_findings(inv.settled_versions(inv.candidates(manifests(spark, sf))), findings)


@query("l9_digest", f"""
SELECT repo_id, list_position([{', '.join(q(n) for n in iv.DIGEST_NAMES)}], path)::BIGINT - 1 AS ord, path AS name, concat('### ', path, chr(10), '```', chr(10), content, chr(10), '```') AS snippet
FROM {{manifests}} WHERE path IN ({', '.join(q(n) for n in iv.DIGEST_NAMES)})""")
def l9(spark, sf):
    return out(inv.digest(manifests(spark, sf)))


# ---- M --------------------------------------------------------------------------

define("q_words", "SELECT DISTINCT question_id, unnest(list_filter(string_split_regex(lower(question), '\\s+'), lambda w: length(w) >= 3)) AS word FROM {questions}")
define("retrieved", """
SELECT DISTINCT w.question_id, n.id FROM (SELECT word, list(question_id) AS qs FROM {q_words} GROUP BY ALL) x JOIN {star_nodes} n ON contains(lower(n.name), x.word) OR n.domain = x.word
  OR list_contains(string_split(n.effects_text, ','), x.word) OR list_contains(list_transform(string_split(n.effects_text, ','), lambda e: string_split(e, ':')[1]), x.word) JOIN {q_words} w ON w.word = x.word""")


def questions(spark, sf):
    return view(spark, sf, "questions").withColumn("repo_id", F.lit("star"))


@query("m1_retrieve", "SELECT question_id, id FROM {retrieved}")
def m1(spark, sf):
    return xo.retrieve(questions(spark, sf), nodes(spark, sf)).drop("repo_id")


@query("m2_context", """
SELECT question_id, id, rank, line FROM (SELECT question_id, n.id, row_number() OVER (PARTITION BY question_id ORDER BY n.ord)::BIGINT AS rank,
  concat_ws('  ', concat(name, ' (', type, ')'), concat('in ', file_path), concat('— ', summary[1:100]), CASE WHEN domain <> '' THEN concat('[', domain, ']') END, CASE WHEN effects_text <> '' THEN concat('effects: ', replace(effects_text, ',', ', ')) END) AS line
  FROM (SELECT question_id, id FROM {retrieved} UNION SELECT question_id, a.nxt FROM {retrieved} r JOIN {adj} a ON a.id = r.id) m JOIN {star_nodes} n ON n.id = m.id) x WHERE rank <= 30""")
def m2(spark, sf):
    return out(xo.context(questions(spark, sf), nodes(spark, sf), edges(spark, sf)).drop("repo_id"))


define("golden_scored", """
SELECT g.name, n.id IS NOT NULL AS found, CASE WHEN n.id IS NULL THEN 0.0 ELSE round_even(coalesce(list_avg(list_filter([
    CASE WHEN has_effects THEN CASE WHEN expected_effects <> '' THEN len(list_intersect(fam, string_split(expected_effects, ','))) / len(string_split(expected_effects, ',')) WHEN len(fam) = 0 THEN 1.0 ELSE 0.5 END END,
    CASE WHEN has_control THEN CASE WHEN expected_control = '' THEN 0.0 ELSE len(list_intersect(flow, string_split(expected_control, ','))) / len(string_split(expected_control, ',')) END END,
    CASE WHEN has_role THEN CASE WHEN n.role = expected_role THEN 1.0 ELSE 0.0 END END], lambda x: x IS NOT NULL)), 0), 2) END::DOUBLE AS score
FROM {golden} g LEFT JOIN (SELECT *, list_distinct(list_transform(list_filter(string_split(effects_text, ','), lambda e: e <> ''), lambda e: string_split(e, ':')[1])) AS fam, list_filter(string_split(flow_text, ','), lambda f: f <> '') AS flow
  FROM {star_nodes} WHERE id IN (SELECT arg_max(id, ord) FROM {star_nodes} GROUP BY name)) n ON n.name = g.name""")


def golden(spark, sf):
    parts = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    g = view(spark, sf, "golden")
    return g.select("repo_id", "name", F.when(F.col("has_effects"), parts("expected_effects")).alias("expected_effects"),
                    F.when(F.col("has_control"), parts("expected_control")).alias("expected_control"), F.when(F.col("has_role"), F.col("expected_role")).alias("expected_role"))


@query("m3_golden_scores", "SELECT name, score, found FROM {golden_scored}")
def m3(spark, sf):
    return xo.golden_scores(golden(spark, sf), nodes(spark, sf)).drop("repo_id")


@query("m4_golden_overall", "SELECT round_even(sum(score) / count(*), 2)::DOUBLE AS overall FROM {golden_scored}")
def m4(spark, sf):
    return xo.golden_overall(xo.golden_scores(golden(spark, sf), nodes(spark, sf))).select("overall")


define("shown", "SELECT * FROM {star_layer} WHERE id IN (SELECT id FROM {ends}) AND type IN ('class', 'function') AND complexity IN ('complex', 'moderate') AND language <> 'php'")


def shown(spark, sf):
    return xo.visible(nodes(spark, sf), edges(spark, sf), types=["class", "function"], complexities=["complex", "moderate"], languages=["python", "javascript"])


@query("m5_explorer_filter", "SELECT id FROM {shown} WHERE layer_id = 'service'")
def m5(spark, sf):
    return xo.visible(nodes(spark, sf), edges(spark, sf), types=["class", "function"], layer="service", complexities=["complex", "moderate"], languages=["python", "javascript"]).select("id")


@query("m6_explorer_top", """
SELECT * FROM (SELECT id, row_number() OVER (ORDER BY CASE complexity WHEN 'complex' THEN 0 ELSE 1 END, CASE type WHEN 'class' THEN 0 ELSE 1 END, ord)::BIGINT AS rank, count(*) OVER ()::BIGINT AS total FROM {shown}) x WHERE rank <= 500""")
def m6(spark, sf):
    return out(xo.top_visible(shown(spark, sf), 500).select("id", "rank", "total"))


@query("m7_stats", """
SELECT count(*) FILTER (type = 'file')::BIGINT AS files, count(*) FILTER (type = 'function')::BIGINT AS functions, count(*) FILTER (type = 'class')::BIGINT AS classes, count(DISTINCT language)::BIGINT AS languages,
  (SELECT count(*) FROM {star_edges})::BIGINT AS edges FROM {star_nodes}""")
def m7(spark, sf):
    return xo.stats(nodes(spark, sf), edges(spark, sf)).drop("repo_id")


@query("m8_languages", "SELECT language, count(*)::BIGINT AS n FROM {star_nodes} GROUP BY ALL")
def m8(spark, sf):
    return xo.languages(nodes(spark, sf)).drop("repo_id")


@query("m9_search", "SELECT id, name FROM {star_nodes} WHERE contains(lower(concat(name, ' ', file_path)), 'nation_3') ORDER BY ord LIMIT 30")
def m9(spark, sf):
    return xo.search(nodes(spark, sf), "Nation_3").select("id", "name")
