"""Domain, tour, onboarding and hub reports.

Every report is a table first and lines second. Lists are cut with ranked rows, so a
repository that holds a large share of the corpus never gathers in one task.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import paths, text as tx
from ..functions.ordered import first_rows, numbered
from ..functions.tables import written
from ..rules import graph as gr
from . import build, traverse as tv

NODE = ["repo_id", "id"]
LINE = ["repo_id", "section", "ord", "line"]


def _symbols(nodes):
    return nodes.where(F.col("type").isin("function", "class"))


def _has_effect(effects, word) -> Column:
    return F.exists(effects, lambda e: F.contains(e, F.lit(word)))


def _ordered_names(order: str, name: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda s: s[name])


# ---- domains --------------------------------------------------------------------


def domain_nodes(nodes: DataFrame) -> DataFrame:
    return _symbols(nodes).withColumn("domain", tv.domain_of()).where(F.col("domain") != "")


def domains(nodes: DataFrame, keys: int = 10) -> DataFrame:
    """Per domain: node count, first names, position of its first node."""
    rows = domain_nodes(nodes)
    sizes = rows.groupBy("repo_id", "domain").agg(F.count("*").alias("node_count"), F.min("ord").alias("first_ord"))
    named = first_rows(rows, ["repo_id", "domain"], ["ord"], keys).groupBy("repo_id", "domain").agg(_ordered_names("rank", "name").alias("key_nodes"))
    return sizes.join(named, ["repo_id", "domain"])


def domain_entries(nodes: DataFrame, used: int = 5, fallback: int = 3) -> DataFrame:
    """Entry points of each domain, or its first nodes where it has none."""
    rows = domain_nodes(nodes).withColumn("_late", F.when(tv.role_of() == "entry_point", 0).otherwise(1))
    head = first_rows(rows, ["repo_id", "domain"], ["_late", "ord"], used)
    best = F.min("_late").over(Window.partitionBy("repo_id", "domain"))   # over at most ``used`` rows
    return (
        head.withColumn("_best", best)
        .where((F.col("_late") == 0) | ((F.col("_best") == 1) & (F.col("rank") <= fallback)))
        .select("repo_id", "domain", "rank", "id", "name", "ord")
    )


def _chain_names(chain_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    names = nodes.select(*NODE, "name", "file_path", tv.effect_types(nodes).alias("effects"))
    return chain_rows.join(names, NODE).groupBy("repo_id", "entry").agg(
        F.array_sort(F.collect_list(F.struct("step", "name", "file_path", "effects", "id"))).alias("steps"))


def domain_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Call chains of at least two steps from the entries of each domain."""
    entries = domain_entries(nodes)
    flows = _chain_names(tv.chains(entries, nodes, edges, max_nodes=6, max_depth=6), nodes).where(F.size("steps") >= 2)
    return entries.select("repo_id", "domain", "rank", F.col("id").alias("entry"), F.col("name").alias("entry_name")).join(
        flows, ["repo_id", "entry"]).select("repo_id", "domain", "rank", "entry", "entry_name", "steps")


def domain_lines(domain_rows: DataFrame, flows: DataFrame, keys: int = 6) -> DataFrame:
    """Listing lines; domains by size, flows after the key line."""
    place = F.concat(F.lpad((F.lit(10 ** 12) - F.col("node_count")).cast("string"), 13, "0"), "first_ord")
    base = domain_rows.withColumn("_place", place)
    head = base.select("repo_id", F.col("_place").alias("section"), F.posexplode(F.array(
        F.concat(F.upper("domain"), F.lit(" ("), "node_count", F.lit(" nodes)")),
        F.concat(F.lit("Key: "), F.array_join(F.slice("key_nodes", 1, keys), ", ")))).alias("ord", "line"))
    arrows = flows.join(base.select("repo_id", "domain", "_place"), ["repo_id", "domain"]).select(
        "repo_id", F.col("_place").alias("section"), (F.col("rank") + 1).alias("ord"),
        F.concat(F.lit("Flow: "), F.array_join(F.transform("steps", lambda s: s["name"]), " → ")).alias("line"))
    return head.unionByName(arrows)


# ---- tour ---------------------------------------------------------------------


def domain_files(nodes: DataFrame, edges: DataFrame, domain: str) -> DataFrame:
    """File nodes that contain a symbol of the domain."""
    members = domain_nodes(nodes).where(F.col("domain") == domain).select("repo_id", F.col("id").alias("dst"))
    files = edges.where(F.col("type") == "contains").join(members, ["repo_id", "dst"], "left_semi").select("repo_id", F.col("src").alias("id"))
    return nodes.where(F.col("type") == "file").join(files.distinct(), NODE, "left_semi")


def _layer_rank(order) -> Column:
    return tx.lookup({name: i for i, name in enumerate(order)}, F.col("layer"))


def _with_layer(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("layer", build.layer_name(build.layer_of(F.col("file_path"), F.col("language"))))


def tour(file_nodes: DataFrame, keys: int = 5) -> DataFrame:
    """Stops: one per layer and directory, with file count and key files."""
    rows = _with_layer(file_nodes.where(F.col("type") == "file")).select(
        "repo_id", "layer", paths.parent(F.col("file_path")).alias("directory"), "name", "ord",
        F.when(F.col("complexity") == "complex", 0).otherwise(1).alias("_plain"), F.length("summary").alias("_len"))
    stop = ["repo_id", "layer", "directory"]
    sizes = rows.groupBy(*stop).agg(F.count("*").alias("file_count"), F.min("ord").alias("first_ord"))
    named = first_rows(rows, stop, ["_plain", F.desc("_len"), "ord"], keys).groupBy(*stop).agg(_ordered_names("rank", "name").alias("key_files"))
    return sizes.join(named, stop).withColumn("layer_rank", _layer_rank(gr.TOUR_ORDER))


def tour_lines(stops: DataFrame, shown: int = 4) -> DataFrame:
    """``Stop i/n`` lines in layer order, largest directories first."""
    counts = stops.groupBy("repo_id").agg(F.count("*").alias("_n"))
    placed = numbered(stops.withColumn("_less", -F.col("file_count")), ["repo_id"], ["layer_rank", "_less", "first_ord"], "stop").join(counts, "repo_id")
    texts = F.array(
        F.concat(F.lit("Stop "), "stop", F.lit("/"), "_n", F.lit(": "), "layer", F.lit(" ("), "directory", F.lit("/)")),
        F.concat(F.col("file_count"), F.lit(" files — Key: "), F.array_join(F.slice("key_files", 1, shown), ", ")))
    return placed.select("repo_id", F.col("stop").alias("section"), F.posexplode(texts).alias("ord", "line"))


# ---- onboarding sections ------------------------------------------------------


def overview(nodes: DataFrame, frameworks: DataFrame = None, languages: int = 8) -> DataFrame:
    """Counts, first languages by appearance, frameworks as ``name version``."""
    counts = nodes.groupBy("repo_id").agg(*[F.count_if(F.col("type") == t).alias(n) for t, n in
                                            (("file", "files"), ("function", "functions"), ("class", "classes"))])
    seen = nodes.where(F.col("type") == "file").groupBy("repo_id", "language").agg(F.min("ord").alias("ord"))
    langs = first_rows(seen, ["repo_id"], ["ord"], languages).groupBy("repo_id").agg(F.array_join(_ordered_names("rank", "language"), ", ").alias("languages"))
    out = counts.join(langs, "repo_id", "left")
    if frameworks is None:
        return out.withColumn("frameworks", F.lit("—"))
    listed = frameworks.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "name", "version"))), ", ").alias("frameworks"))
    return out.join(listed, "repo_id", "left").withColumn("frameworks", F.coalesce("frameworks", F.lit("—")))


def layers_by_size(nodes: DataFrame) -> DataFrame:
    """Layers ranked by node count (there are at most seven)."""
    return first_rows(build.layer_sizes(build.node_layers(nodes)), ["repo_id"], [F.desc("nodes"), F.col("layer_id")], len(gr.LAYERS))


def key_components(scored_nodes: DataFrame, top: int = 20) -> DataFrame:
    """Most important symbols; rows without importance are left out."""
    rows = _symbols(scored_nodes).withColumn("importance", F.col("semantics.importance")).where("importance > 0")
    return first_rows(rows, ["repo_id"], [F.desc("importance"), F.col("ord")], top)


def hotspots(nodes: DataFrame, top: int = 15) -> DataFrame:
    """Complex symbols with the widest line span."""
    span = F.col("line_range.end") - F.col("line_range.start")
    rows = _symbols(nodes).where(F.col("complexity") == "complex").withColumn("_span", span)
    return first_rows(rows, ["repo_id"], [F.desc("_span"), F.col("ord")], top).withColumn(
        "lines", F.when(F.col("_span") > 0, F.col("_span") + 1).otherwise(0))


def reading_order(nodes: DataFrame, files: int = None, dirs: int = None) -> DataFrame:
    """Layers in reading order with the directories of their files; only the first ones if limits are given."""
    rows = _with_layer(nodes)
    present = rows.groupBy("repo_id", "layer").agg(F.count("*").alias("nodes"))
    head = rows.where(F.col("type") == "file")
    head = head if files is None else first_rows(head, ["repo_id", "layer"], ["ord"], files)
    listed = head.groupBy("repo_id", "layer").agg(F.array_sort(F.collect_set(paths.parent(F.col("file_path")))).alias("directories"))
    listed = listed if dirs is None else listed.withColumn("directories", F.slice("directories", 1, dirs))
    joined = present.join(listed, ["repo_id", "layer"], "left").withColumn("layer_rank", _layer_rank(gr.READING_ORDER)).where(F.col("layer_rank").isNotNull())
    return joined.select("repo_id", "layer", "layer_rank", F.coalesce(F.when(F.size("directories") > 0, F.array_join("directories", ", ")), F.lit("various")).alias("directories"))


def _entry_flows(entries: DataFrame, nodes: DataFrame, edges: DataFrame, mark: Column, kept: Column, shown: int) -> DataFrame:
    """The first ``shown`` chains of two steps or more per repository for which ``kept`` holds, an aggregate over the ``mark``
    of the chain's nodes. Every entry is followed; names and effects are gathered for the chains that are shown only."""
    entries = written(entries, "entries")
    steps = written(tv.chains(entries, nodes, edges, max_nodes=2000, max_depth=6), "chains")
    judged = steps.join(nodes.select(*NODE, mark.alias("mark")), NODE).groupBy("repo_id", "entry").agg(F.count("*").alias("_n"), kept.alias("_kept"))
    fit = entries.select("repo_id", F.col("id").alias("entry"), F.col("rank").alias("_from")).join(judged.where("_n >= 2 and _kept"), ["repo_id", "entry"])
    head = written(first_rows(fit.drop("_n", "_kept"), ["repo_id"], ["_from"], shown), "shown")
    named = _chain_names(steps.join(head.select("repo_id", "entry").distinct(), ["repo_id", "entry"], "left_semi"), nodes)
    return head.join(named, ["repo_id", "entry"])


def _first_entries(rows: DataFrame, entries: int = None) -> DataFrame:
    """Entries with their place in the repository; all of them unless a limit is given."""
    return numbered(rows, ["repo_id"], ["ord"], "rank") if entries is None else first_rows(rows, ["repo_id"], ["ord"], entries)


def api_flows(nodes: DataFrame, edges: DataFrame, entries: int = None, shown: int = 8) -> DataFrame:
    """The first ``shown`` chains from entry points that touch an external service; every entry point is followed."""
    first = _first_entries(_symbols(nodes).where(tv.role_of() == "entry_point"), entries)
    mark = _has_effect(tv.effect_types(nodes), "external_api")
    flows = _entry_flows(first, nodes, edges, mark, F.bool_or("mark"), shown)
    effects = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("steps", lambda s: s["effects"])), lambda e: F.contains(e, F.lit("external_api")))))
    return flows.withColumn("effects", effects)


def data_flows(nodes: DataFrame, edges: DataFrame, writers: int = None, callers: int = None) -> DataFrame:
    """Database writers, the first of each name, with their callers in order; limits apply to names and callers."""
    effects = tv.effect_types(nodes)
    rows = _symbols(nodes).where(_has_effect(effects, "db_write")).withColumn("targets", F.filter(effects, lambda e: F.contains(e, F.lit("db_write"))))
    once = rows.groupBy("repo_id", "name").agg(F.min_by(F.struct("id", "targets", "ord"), "ord").alias("w")).select("repo_id", "name", "w.*")
    once = numbered(once, ["repo_id"], ["ord"], "rank") if writers is None else first_rows(once, ["repo_id"], ["ord"], writers)
    once = once.drop("ord")
    names = nodes.select("repo_id", F.col("id").alias("caller"), F.col("name").alias("caller_name"), F.col("ord").alias("caller_ord"))
    who = tv.callers(edges, once).join(names, ["repo_id", "caller"]).withColumn("_r", F.struct("caller_ord", "caller"))
    who = who if callers is None else first_rows(who, NODE, ["_r"], callers, "_n")
    who = who.groupBy(*NODE).agg(F.array_join(_ordered_names("_r", "caller_name"), ", ").alias("callers"))
    return once.join(who, NODE, "left").withColumn("callers", F.coalesce("callers", F.lit("")))


def request_flows(nodes: DataFrame, edges: DataFrame, entries: int = None, shown: int = 10) -> DataFrame:
    """The first ``shown`` chains from API and UI symbols that cross at least two layers; every such symbol is followed."""
    rows = _with_layer(_symbols(nodes)).where(F.col("layer").isin("API / Routes", "UI / Frontend"))
    place = build.layer_name(build.layer_of(F.col("file_path"), F.col("language")))
    flows = _entry_flows(_first_entries(rows, entries), nodes, edges, place, F.size(F.collect_set("mark")) >= 2, shown)
    layer = _with_layer(nodes).select(*NODE, "layer")
    crossed = (
        flows.select("repo_id", "entry", F.explode("steps").alias("s")).select("repo_id", "entry", F.col("s.step").alias("step"), F.col("s.id").alias("id"))
        .join(layer, NODE).groupBy("repo_id", "entry").agg(F.array_distinct(_ordered_names("step", "layer")).alias("layers"))
    )
    return flows.join(crossed, ["repo_id", "entry"])


def hubs(nodes: DataFrame, edges: DataFrame, top: int = 30) -> DataFrame:
    """Most connected project symbols; library paths and common names are left out."""
    rows = _symbols(nodes).where((F.col("name") != "") & ~F.col("name").isin(gr.HUB_SKIP_NAMES) & ~paths.overlaps(F.col("file_path"), gr.HUB_SKIP_PATHS))
    joined = rows.join(tv.degrees(edges), NODE, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    weight = F.when(F.col("complexity") == "complex", 0).when(F.col("complexity") == "moderate", 1).otherwise(2)
    keyed = joined.withColumn("_c", weight).withColumn("_t", F.when(F.col("type") == "class", 0).otherwise(1)).withColumn("_l", F.length("summary"))
    return first_rows(keyed, ["repo_id"], [F.desc("degree"), "_c", "_t", F.desc("_l"), "ord"], top)


def hub_lines(hub_rows: DataFrame) -> DataFrame:
    effects = tv.effect_types(hub_rows)
    line = F.concat(
        F.lit("- `"), "name", F.lit("` ("), "type", F.lit(", "), "complexity", F.lit(") in `"), "file_path", F.lit("`"),
        F.when(tv.domain_of() != "", F.concat(F.lit(" — domain: "), tv.domain_of())).otherwise(F.lit("")),
        F.when(tv.role_of() != "", F.concat(F.lit(", role: "), tv.role_of())).otherwise(F.lit("")),
        F.when(F.size(effects) > 0, F.concat(F.lit(", effects: "), F.array_join(effects, ", "))).otherwise(F.lit("")))
    return hub_rows.select("repo_id", F.col("rank").alias("ord"), line.alias("line"))


def project_card(nodes: DataFrame, versions: DataFrame = None) -> DataFrame:
    """Lines of the project card: counts per type, nodes per layer, versions listing."""
    types = nodes.groupBy("repo_id", "type").agg(F.count("*").alias("n"))
    plural = F.when(F.col("type") == "class", "es").otherwise("s")
    stats = types.groupBy("repo_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.concat("n", F.lit(" "), "type", plural).alias("t")))), lambda s: s["t"]), ", ").alias("line"))
    out = stats.select("repo_id", F.lit(0).alias("section"), F.lit(0).cast("string").alias("ord"), F.concat(F.lit("- "), "line").alias("line"))
    order = tx.lookup({lid: str(i) for i, (lid, _, _) in enumerate(gr.LAYERS)}, F.col("layer_id"))
    layers = build.layer_sizes(build.node_layers(nodes)).select(
        "repo_id", F.lit(1).alias("section"), order.alias("ord"), F.concat(F.lit("- **"), "name", F.lit("**: "), "nodes", F.lit(" nodes")).alias("line"))
    out = out.unionByName(layers)
    if versions is not None:
        out = out.unionByName(versions.select(
            "repo_id", F.lit(2).alias("section"), F.concat_ws("/", "section", "name").alias("ord"), F.concat(F.lit("  - "), "name", F.lit(": "), "version").alias("line")))
    return out


def _component_text() -> Column:
    effects = F.transform("semantics.side_effects", lambda e: e["type"])
    return F.concat(F.lit("- "), F.array_join(F.array_compact(F.array(
        F.concat(F.lit("`"), "name", F.lit("`")), F.concat(F.lit("("), "type", F.lit(")")),
        F.when(tv.role_of() != "", tv.role_of()), F.when(tv.domain_of() != "", F.concat(F.lit("["), tv.domain_of(), F.lit("]"))),
        F.when(F.size(effects) > 0, F.concat(F.lit("→ "), F.array_join(F.slice(effects, 1, 3), ", "))),
        F.concat(F.lit("in `"), "file_path", F.lit("`")))), " · "))


def guide(nodes: DataFrame, edges: DataFrame, frameworks: DataFrame = None) -> DataFrame:
    """All onboarding sections as ordered lines; an empty section gives no lines, not even a title."""
    def arrow(steps, n):
        return F.array_join(F.transform(F.slice(steps, 1, n), lambda s: F.concat(F.lit("`"), s["name"], F.lit("`"))), " → ")

    over = overview(nodes, frameworks)
    rows = [F.concat(F.lit(f"| {label} | "), F.col(col).cast("string"), F.lit(" |")) for label, col in (
        ("Languages", "languages"), ("Files", "files"), ("Functions", "functions"), ("Classes", "classes"), ("Frameworks", "frameworks"))]
    parts = [
        ("## Overview", over.select("repo_id", F.posexplode(F.array(*rows)).alias("ord", "line"))),
        ("## Architecture", layers_by_size(nodes).select("repo_id", F.col("rank").alias("ord"), F.concat(F.lit("- **"), "name", F.lit("** ("), "nodes", F.lit(" nodes)")).alias("line"))),
        ("## Key Components", key_components(nodes).select("repo_id", F.col("rank").alias("ord"), _component_text().alias("line"))),
        ("## Complexity Hotspots", hotspots(nodes).select("repo_id", F.col("rank").alias("ord"), F.concat(F.lit("- `"), "name", F.lit("` ("), "lines", F.lit(" lines) in `"), "file_path", F.lit("`")).alias("line"))),
        ("## Recommended Reading Order", reading_order(nodes).select("repo_id", F.col("layer_rank").alias("ord"), F.concat(F.lit("**"), "layer", F.lit("** — "), "directories").alias("line"))),
        ("## API Call Flows", api_flows(nodes, edges).select("repo_id", F.col("rank").alias("ord"), F.concat(F.lit("- "), arrow("steps", 6), F.lit(" ("), F.array_join("effects", ", "), F.lit(")")).alias("line"))),
        ("## Data Flows", data_flows(nodes, edges).select("repo_id", F.col("rank").alias("ord"), F.concat(
            F.lit("- `"), "name", F.lit("` ("), F.array_join("targets", ", "), F.lit(")"),
            F.when(F.col("callers") != "", F.concat(F.lit(" ← called by "), "callers")).otherwise(F.lit(""))).alias("line"))),
        ("## Request Flows", request_flows(nodes, edges).select("repo_id", F.col("rank").alias("ord"), F.concat(F.lit("- "), arrow("steps", 5), F.lit("  Layers: "), F.array_join("layers", " → ")).alias("line"))),
    ]
    out = None
    for i, (title, rows_) in enumerate(parts):
        body = rows_.select("repo_id", F.lit(i).alias("section"), (F.col("ord") + 1).cast("int").alias("ord"), "line")
        head = body.select("repo_id").distinct().select("repo_id", F.lit(i).alias("section"), F.lit(0).alias("ord"), F.lit(title).alias("line"))
        section = head.unionByName(body)
        out = section if out is None else out.unionByName(section)
    return out
