"""Change-impact report: changed nodes, their neighbours, layers, risk, unmapped paths."""

from pyspark.sql import Column, DataFrame, functions as F

from . import build, traverse as tv
from ..functions.ordered import first_rows

NODE = ["repo_id", "id"]


def changed_nodes(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """File nodes of changed paths and the symbols they contain."""
    files = nodes.where(F.col("type") == "file").join(
        paths.select("repo_id", F.col("path").alias("file_path")).distinct(), ["repo_id", "file_path"], "left_semi").select(*NODE)
    inner = edges.where(F.col("type") == "contains").select("repo_id", F.col("src").alias("id"), "dst").join(files, NODE, "left_semi")
    return files.unionByName(inner.select("repo_id", F.col("dst").alias("id"))).distinct()


def affected_nodes(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected one-hop neighbours over calls and imports, without the changed nodes."""
    reached = changed.join(tv.neighbours(edges), NODE).select("repo_id", F.col("next").alias("id")).distinct()
    return reached.join(changed, NODE, "left_anti")


def touched_layers(changed: DataFrame, affected: DataFrame, node_layer: DataFrame) -> DataFrame:
    hit = node_layer.join(changed.unionByName(affected), NODE, "left_semi")
    return hit.select("repo_id", build.layer_name(F.col("layer_id")).alias("layer")).distinct()


def severity(nodes: DataFrame) -> Column:
    effects, role = tv.effect_types(nodes), tv.role_of()
    has = lambda word: F.exists(effects, lambda e: F.contains(e, F.lit(word)))
    return (F.when((role == "orchestrator") | has("external_api"), 2)
            .when(role.isin("entry_point", "data_access") | has("db_write"), 1).otherwise(0))


def risk(nodes: DataFrame, changed: DataFrame, paths: DataFrame) -> DataFrame:
    """Highest severity among changed nodes, per repository with changes."""
    worst = nodes.join(changed, NODE, "left_semi").groupBy("repo_id").agg(F.max(severity(nodes)).alias("_s"))
    asked = paths.select("repo_id").distinct()
    level = F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.coalesce("_s", F.lit(0)) + 1)
    return asked.join(worst, "repo_id", "left").select("repo_id", level.alias("risk"))


def unmapped_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    known = nodes.select("repo_id", F.col("file_path").alias("path"))
    return paths.select("repo_id", "path").distinct().join(known, ["repo_id", "path"], "left_anti")


def summaries(nodes: DataFrame, ids: DataFrame, skip_files: bool = False) -> DataFrame:
    """Short node rows; changed lists leave file nodes out."""
    rows = nodes.join(ids, NODE, "left_semi")
    rows = rows.where(F.col("type") != "file") if skip_files else rows
    return rows.select("repo_id", "id", "name", "type", F.col("file_path").alias("file"), tv.domain_of().alias("domain"),
                       tv.role_of().alias("role"), tv.effect_types(rows).alias("effects"), "ord")


def report(nodes: DataFrame, edges: DataFrame, node_layer: DataFrame, paths: DataFrame,
           shown: int = 20, shown_unmapped: int = 5) -> DataFrame:
    """Report lines ``(repo_id, section, ord, line)``: counts, then the first rows of each list."""
    changed = changed_nodes(nodes, edges, paths)
    affected = affected_nodes(changed, edges)
    ch, af = summaries(nodes, changed, True), summaries(nodes, affected)
    layers = touched_layers(changed, affected, node_layer)
    un = unmapped_paths(nodes, paths)

    def counted(df, name):
        return df.groupBy("repo_id").agg(F.count("*").alias(name))

    head = (
        counted(paths.select("repo_id", "path").distinct(), "n_files")
        .join(counted(ch, "n_changed"), "repo_id", "left").join(counted(af, "n_affected"), "repo_id", "left")
        .join(layers.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("layer")), ", ").alias("names"), F.count("*").alias("n_layers")), "repo_id", "left")
        .join(risk(nodes, changed, paths), "repo_id")
        .na.fill(0, ["n_changed", "n_affected", "n_layers"]).na.fill("", ["names"])
    )
    texts = F.array(
        F.concat(F.lit("Changed: "), "n_files", F.lit(" files, "), "n_changed", F.lit(" functions/classes")),
        F.concat(F.lit("Affected: "), "n_affected", F.lit(" nodes across "), "n_layers", F.lit(" layers ("), "names", F.lit(")")),
        F.concat(F.lit("Risk: "), "risk"))
    rows = head.select("repo_id", F.lit(0).alias("section"), F.posexplode(texts).alias("ord", "line"))
    extra = F.array_join(F.array_compact(F.array(
        F.when(F.col("role") != "", F.col("role")), F.when(F.col("domain") != "", F.concat(F.lit("["), "domain", F.lit("]"))),
        F.when(F.size("effects") > 0, F.concat(F.lit("→ "), F.array_join(F.slice("effects", 1, 3), ", "))))), " · ")
    listed = first_rows(ch, ["repo_id"], ["ord"], shown).select(
        "repo_id", F.lit(1).alias("section"), F.col("rank").alias("ord"), F.concat(F.lit("✎ "), "name", F.lit(" ("), "type", F.lit(") "), extra).alias("line"))
    reached = first_rows(af, ["repo_id"], ["ord"], shown).select(
        "repo_id", F.lit(2).alias("section"), F.col("rank").alias("ord"), F.concat(F.lit("→ "), "name", F.lit(" ("), "type", F.lit(") in "), "file").alias("line"))
    missing = first_rows(un, ["repo_id"], ["path"], shown_unmapped).groupBy("repo_id").agg(
        F.concat(F.lit("Unmapped: "), F.array_join(F.array_sort(F.collect_list("path")), ", ")).alias("line")).select(
        "repo_id", F.lit(3).alias("section"), F.lit(0).alias("ord"), "line")
    return rows.unionByName(listed).unionByName(reached).unionByName(missing)
