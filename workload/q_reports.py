"""Domain, tour, onboarding and hub report queries (inventory group I)."""

from pyspark.sql import functions as F

from corpusgraph.functions.tables import new_path
from corpusgraph.operators import importance as im, reports as rp
from corpusgraph.rules import graph as gr
from corpusgraph.sources import graph_io

from .q_extract import q
from .q_graph import define_chains, edges, nodes
from .registry import query
from .sqlbook import define
from .views import out, stored


def scored_nodes(spark, sf):
    return stored(spark, sf, "star_scored", lambda: im.with_importance(nodes(spark, sf), edges(spark, sf)))


define("dom_nodes", "SELECT * FROM {star_nodes} WHERE type IN ('function', 'class') AND domain <> ''")
define("doms", """
SELECT domain, count(*)::BIGINT AS node_count, min(ord) AS first_ord, (list(name ORDER BY ord))[1:10] AS names FROM {dom_nodes} GROUP BY ALL""")


@query("i1_domains", "SELECT domain, node_count, array_to_string(names, '|') AS key_nodes FROM {doms}")
def i1(spark, sf):
    return out(rp.domains(nodes(spark, sf)).select("domain", "node_count", "key_nodes"))


define("dom_entries", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY late, ord) AS rank FROM (
  SELECT *, CASE role WHEN 'entry_point' THEN 0 ELSE 1 END AS late, min(CASE role WHEN 'entry_point' THEN 0 ELSE 1 END) OVER (PARTITION BY domain) AS best FROM {dom_nodes}) x) y
WHERE (late = 0 AND rank <= 5) OR (best = 1 AND rank <= 3)""")


@query("i2_domain_entries", "SELECT domain, rank::BIGINT AS rank, id FROM {dom_entries}")
def i2(spark, sf):
    return out(rp.domain_entries(nodes(spark, sf)).select("domain", "rank", "id"))


define_chains("dom_chains", "dom_entries")
define("dom_flows", """
SELECT e.domain, e.rank::BIGINT AS rank, c.entry, string_agg(n.name, ' → ' ORDER BY c.step) AS steps FROM {dom_chains} c JOIN {star_nodes} n ON n.id = c.id JOIN {dom_entries} e ON e.id = c.entry
WHERE c.step < 6 GROUP BY ALL HAVING count(*) >= 2""")


def flows(spark, sf):
    return rp.domain_flows(nodes(spark, sf), edges(spark, sf))


@query("i3_domain_flows", "SELECT domain, rank, entry, steps FROM {dom_flows}")
def i3(spark, sf):
    return out(flows(spark, sf).select("domain", "rank", "entry", F.array_join(F.transform("steps", lambda s: s["name"]), " → ").alias("steps")))


@query("i4_domain_listing", """
SELECT concat(lpad((1000000000000 - node_count)::VARCHAR, 13, '0'), first_ord) AS section, 0::BIGINT AS ord, concat(upper(domain), ' (', node_count, ' nodes)') AS line FROM {doms}
UNION ALL SELECT concat(lpad((1000000000000 - node_count)::VARCHAR, 13, '0'), first_ord), 1, concat('Key: ', array_to_string(names[1:6], ', ')) FROM {doms}
UNION ALL SELECT concat(lpad((1000000000000 - node_count)::VARCHAR, 13, '0'), first_ord), rank + 1, concat('Flow: ', steps) FROM {dom_flows} f JOIN {doms} d ON d.domain = f.domain""")
def i4(spark, sf):
    n = nodes(spark, sf)
    return out(rp.domain_lines(rp.domains(n), flows(spark, sf)).drop("repo_id"))


def _rank_sql(order, col="layer_name"):
    return f"CASE {col} " + " ".join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(order)) + " END"


def tour_sql(source):
    return f"""
SELECT layer_name AS layer, directory, count(*)::BIGINT AS file_count, min(ord) AS first_ord, {_rank_sql(gr.TOUR_ORDER)}::BIGINT AS layer_rank,
  (list(name ORDER BY CASE complexity WHEN 'complex' THEN 0 ELSE 1 END, length(summary) DESC, ord))[1:5] AS names
FROM (SELECT *, regexp_replace(file_path, '/[^/]*$', '') AS directory FROM {{star_layer}} WHERE type = 'file' AND id IN ({source})) x GROUP BY ALL"""


define("tour", tour_sql("SELECT id FROM {star_nodes}"))
define("tour_focus", tour_sql("SELECT e.src FROM {star_edges} e JOIN {dom_nodes} n ON n.id = e.dst WHERE e.type = 'contains' AND n.domain = 'machinery'"))


def _stops(df):
    return out(df.select("layer", "directory", "file_count", "layer_rank", "key_files"))


@query("i5_tour", "SELECT layer, directory, file_count, layer_rank, array_to_string(names, '|') AS key_files FROM {tour}")
def i5(spark, sf):
    return _stops(rp.tour(nodes(spark, sf)))


@query("i6_tour_focus", "SELECT layer, directory, file_count, layer_rank, array_to_string(names, '|') AS key_files FROM {tour_focus}")
def i6(spark, sf):
    return _stops(rp.tour(rp.domain_files(nodes(spark, sf), edges(spark, sf), "machinery")))


define("tour_placed", "SELECT *, row_number() OVER (ORDER BY layer_rank, file_count DESC, first_ord)::BIGINT AS stop, count(*) OVER () AS n FROM {tour}")


@query("i7_tour_listing", """
SELECT stop AS section, 0::BIGINT AS ord, concat('Stop ', stop, '/', n, ': ', layer, ' (', directory, '/)') AS line FROM {tour_placed}
UNION ALL SELECT stop, 1, concat(file_count, ' files — Key: ', array_to_string(names[1:4], ', ')) FROM {tour_placed}""")
def i7(spark, sf):
    return out(rp.tour_lines(rp.tour(nodes(spark, sf))).drop("repo_id"))


define("overview", """
SELECT count(*) FILTER (type = 'file')::BIGINT AS files, count(*) FILTER (type = 'function')::BIGINT AS functions, count(*) FILTER (type = 'class')::BIGINT AS classes,
  (SELECT string_agg(language, ', ' ORDER BY o) FROM (SELECT language, min(ord) AS o FROM {star_nodes} WHERE type = 'file' GROUP BY ALL ORDER BY o LIMIT 8) l) AS languages, '—' AS frameworks FROM {star_nodes}""")


@query("i8_overview", "SELECT * FROM {overview}")
def i8(spark, sf):
    return rp.overview(nodes(spark, sf)).drop("repo_id")


define("layer_counts", "SELECT layer_id, layer_name AS name, count(*)::BIGINT AS nodes FROM {star_layer} GROUP BY ALL")


@query("i9_layers", "SELECT layer_id, name, nodes, row_number() OVER (ORDER BY nodes DESC, layer_id)::BIGINT AS rank FROM {layer_counts}")
def i9(spark, sf):
    return out(rp.layers_by_size(nodes(spark, sf)).drop("repo_id"))


define("components", """
SELECT n.*, i.importance, row_number() OVER (ORDER BY i.importance DESC, n.ord)::BIGINT AS rank FROM {star_nodes} n JOIN {imp} i ON i.id = n.id WHERE i.importance > 0""")


@query("i10_key_components", "SELECT id, importance, rank FROM {components} WHERE rank <= 20")
def i10(spark, sf):
    return out(rp.key_components(scored_nodes(spark, sf)).select("id", "importance", "rank"))


@query("i11_hotspots", """
SELECT id, rank, lines FROM (SELECT id, row_number() OVER (ORDER BY line_end - line_start DESC, ord)::BIGINT AS rank, CASE WHEN line_end > line_start THEN line_end - line_start + 1 ELSE 0 END::BIGINT AS lines
  FROM {star_nodes} WHERE complexity = 'complex' AND type IN ('function', 'class')) x WHERE rank <= 15""")
def i11(spark, sf):
    return out(rp.hotspots(nodes(spark, sf)).select("id", "rank", "lines"))


@query("i12_reading_order", f"""
SELECT l.layer, l.layer_rank, coalesce(d.directories, 'various') AS directories FROM (SELECT DISTINCT layer_name AS layer, {_rank_sql(gr.READING_ORDER)}::BIGINT AS layer_rank FROM {{star_layer}}) l
LEFT JOIN (SELECT layer_name, array_to_string(list(DISTINCT dir ORDER BY dir), ', ') AS directories FROM (
  SELECT layer_name, regexp_replace(file_path, '/[^/]*$', '') AS dir, row_number() OVER (PARTITION BY layer_name ORDER BY ord) AS r FROM {{star_layer}} WHERE type = 'file') x GROUP BY ALL) d ON d.layer_name = l.layer
WHERE layer_rank IS NOT NULL""")
def i12(spark, sf):
    return out(rp.reading_order(nodes(spark, sf)).drop("repo_id"))


define("api_entries", "SELECT *, row_number() OVER (ORDER BY ord) AS rank FROM {star_nodes} WHERE type IN ('function', 'class') AND role = 'entry_point'")
define_chains("api_chains", "api_entries")
define("api_steps", """
SELECT c.entry, e.rank, list(n.name ORDER BY c.step) AS names, bool_or(contains(n.effects_text, 'external_api')) AS hit, count(*) AS n
FROM {api_chains} c JOIN {star_nodes} n ON n.id = c.id JOIN {api_entries} e ON e.id = c.entry GROUP BY ALL""")


@query("i13_api_flows", "SELECT entry, row_number() OVER (ORDER BY rank)::BIGINT AS rank, array_to_string(names[1:6], ' → ') AS steps, 'external_api:stripe' AS effects FROM {api_steps} WHERE hit AND n >= 2 QUALIFY row_number() OVER (ORDER BY rank) <= 8")
def i13(spark, sf):
    return out(rp.api_flows(nodes(spark, sf), edges(spark, sf)).select(
        "entry", "rank", F.array_join(F.transform(F.slice("steps", 1, 6), lambda s: s["name"]), " → ").alias("steps"), "effects"))


define("writers", """
SELECT *, row_number() OVER (ORDER BY ord)::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS rn FROM {star_nodes} WHERE type IN ('function', 'class') AND contains(effects_text, 'db_write')) x WHERE rn = 1""")


@query("i14_data_flows", """
SELECT w.name, w.id, w.rank, 'db_write:orders' AS targets, coalesce(c.callers, '') AS callers FROM {writers} w LEFT JOIN (
  SELECT e.dst, array_to_string(list(n.name ORDER BY n.ord), ', ') AS callers FROM {star_edges} e JOIN {star_nodes} n ON n.id = e.src WHERE e.type = 'calls' GROUP BY ALL) c ON c.dst = w.id""")
def i14(spark, sf):
    return out(rp.data_flows(nodes(spark, sf), edges(spark, sf)).drop("repo_id"))


define("req_entries", "SELECT *, row_number() OVER (ORDER BY ord) AS rank FROM {star_layer} WHERE type IN ('function', 'class') AND layer_id IN ('api', 'ui')")
define_chains("req_chains", "req_entries")
define("req_steps", """
SELECT c.entry, e.rank, list(n.name ORDER BY c.step) AS names, list(n.layer_name ORDER BY c.step) AS ls FROM {req_chains} c JOIN {star_layer} n ON n.id = c.id JOIN {req_entries} e ON e.id = c.entry GROUP BY ALL""")


@query("i15_request_flows", """
SELECT entry, row_number() OVER (ORDER BY rank)::BIGINT AS rank, array_to_string(names[1:5], ' → ') AS steps,
  array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), ' → ') AS layers
FROM {req_steps} WHERE len(names) >= 2 AND len(list_distinct(ls)) >= 2 QUALIFY row_number() OVER (ORDER BY rank) <= 10""")
def i15(spark, sf):
    return out(rp.request_flows(nodes(spark, sf), edges(spark, sf)).select(
        "entry", "rank", F.array_join(F.transform(F.slice("steps", 1, 5), lambda s: s["name"]), " → ").alias("steps"), F.array_join("layers", " → ").alias("layers")))


define("hubs", f"""
SELECT n.*, coalesce(d.degree, 0)::BIGINT AS degree, row_number() OVER (ORDER BY coalesce(d.degree, 0) DESC, CASE complexity WHEN 'complex' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, CASE type WHEN 'class' THEN 0 ELSE 1 END, length(summary) DESC, ord)::BIGINT AS rank
FROM {{star_nodes}} n LEFT JOIN (SELECT id, count(*) AS degree FROM {{ends}} GROUP BY ALL) d ON d.id = n.id
WHERE type IN ('class', 'function') AND name NOT IN ({", ".join(q(v) for v in gr.HUB_SKIP_NAMES)}) AND NOT list_has_any(string_split(lower(file_path), '/'), [{", ".join(q(v) for v in gr.HUB_SKIP_PATHS)}])
QUALIFY rank <= 30""")


@query("i16_hubs", """
SELECT rank AS ord, concat('- `', name, '` (', type, ', ', complexity, ') in `', file_path, '`', CASE WHEN domain <> '' THEN concat(' — domain: ', domain) ELSE '' END,
  CASE WHEN role <> '' THEN concat(', role: ', role) ELSE '' END, CASE WHEN effects_text <> '' THEN concat(', effects: ', replace(effects_text, ',', ', ')) ELSE '' END) AS line FROM {hubs}""")
def i16(spark, sf):
    return out(rp.hub_lines(rp.hubs(nodes(spark, sf), edges(spark, sf))).drop("repo_id"))


@query("i17_project_card", f"""
SELECT 0::BIGINT AS section, '0' AS ord, concat('- ', string_agg(concat(n, ' ', type, CASE type WHEN 'class' THEN 'es' ELSE 's' END), ', ' ORDER BY n DESC)) AS line FROM (SELECT type, count(*) AS n FROM {{star_nodes}} GROUP BY ALL) x
UNION ALL SELECT 1, ({_rank_sql([lid for lid, _, _ in gr.LAYERS], 'layer_id')})::VARCHAR, concat('- **', name, '**: ', nodes, ' nodes') FROM {{layer_counts}}""")
def i17(spark, sf):
    return out(rp.project_card(nodes(spark, sf)).drop("repo_id"))


@query("i18_guide", """
SELECT section, ord, line FROM (
  SELECT 0::BIGINT AS section, 0::BIGINT AS ord, '## Overview' AS line
  UNION ALL SELECT 0, 1, concat('| Languages | ', languages, ' |') FROM {overview} UNION ALL SELECT 0, 2, concat('| Files | ', files, ' |') FROM {overview}
  UNION ALL SELECT 0, 3, concat('| Functions | ', functions, ' |') FROM {overview} UNION ALL SELECT 0, 4, concat('| Classes | ', classes, ' |') FROM {overview}
  UNION ALL SELECT 0, 5, '| Frameworks | — |'
  UNION ALL SELECT 1, 0, '## Architecture' UNION ALL SELECT 1, 1 + row_number() OVER (ORDER BY nodes DESC, layer_id), concat('- **', name, '** (', nodes, ' nodes)') FROM {layer_counts}
  UNION ALL SELECT 2, 0, '## Key Components'
  UNION ALL SELECT 2, 1 + rank, concat('- ', concat_ws(' · ', concat('`', name, '`'), concat('(', type, ')'), nullif(role, ''), CASE WHEN domain <> '' THEN concat('[', domain, ']') END,
    CASE WHEN effects_text <> '' THEN concat('→ ', replace(effects_text, ',', ', ')) END, concat('in `', file_path, '`'))) FROM {components} WHERE rank <= 20) x""")
def i18(spark, sf):
    full = rp.guide(scored_nodes(spark, sf), edges(spark, sf))
    return out(full.where("section <= 2").drop("repo_id"))


@query("i18_guide_full")
def i18_full(spark, sf):
    return out(rp.guide(scored_nodes(spark, sf), edges(spark, sf)))


@query("a12_report_sink", "SELECT count(*)::BIGINT AS lines FROM (SELECT 1 FROM {tour_placed} UNION ALL SELECT 1 FROM {tour_placed}) x")
def a12(spark, sf):
    path = new_path(spark, "report")
    lines = rp.tour_lines(rp.tour(nodes(spark, sf))).withColumn("ord", F.col("section") * 10 + F.col("ord"))
    graph_io.save_report(lines, path)
    return spark.read.text(path).agg(F.count("*").alias("lines"))


@query("a14_domain_sink", "SELECT domain, node_count FROM {doms}")
def a14(spark, sf):
    path = new_path(spark, "domains")
    graph_io.save_domains(rp.domains(nodes(spark, sf)), path)
    return spark.read.schema("domain string, node_count bigint").json(path)
