"""Graph assembly: node rows, the four edge kinds, layers, modules, totals."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths, text as tx
from ..functions.ordered import first_rows, latest_before
from ..rules import complexity as cx, graph as gr
from ..schemas import SEMANTICS
from . import complexity, extract, semantics

# ---- units: one row per file and per symbol, computed in one pass -------------


UNIT = ("repo_id path language kind seq name line_start line_end params decorators bases methods imports call_tokens exports "
        "side_effects control_flow domain role complexity is_first summary id file_id ord").split()


def units(files: DataFrame, rules=cx.DEFAULT_RULES, extra_rules: dict = None, only: list = None) -> DataFrame:
    """Every file and every symbol definition with tags and complexity.

    One narrow pass over the text: extraction and file tags run inside the file row,
    then the row is unfolded into itself plus its symbols. File rows also carry the
    import and call-token arrays. No exchange.

    ``only`` names the columns to give (default: all of ``UNIT``). A member is one value to the optimizer, so what
    is not asked for (a symbol's own lines, the file's arrays) is left out here.
    """
    only = only or UNIT
    texts = any(c in only for c in ("complexity", "domain", "summary"))
    ext = extract.extracted(files, extra_rules, keep_others=True)
    tagged = semantics.file_semantics(ext)
    lines = extract.line_count(F.col("content")).cast("int")
    none = F.array().cast("array<string>")
    file_only = [c for c in ("imports", "call_tokens", "exports") if c in only]
    kinds = dict(tagged.select(*file_only).dtypes)
    itself = F.struct(
        F.lit("file").alias("kind"), paths.file_name(F.col("path")).alias("name"), F.lit(1).alias("line_start"),
        lines.alias("line_end"), none.alias("params"), none.alias("decorators"), none.alias("bases"), none.alias("methods"),
        F.lit(True).alias("is_first"), *([F.col("content").alias("text")] if texts else []), *[F.col(c) for c in file_only])

    # Each member gets its own lines and the file-only arrays stay with the file's member, so that
    # unfolding copies nothing that grows with the file.
    def members(bound):
        def member(s, i):
            return F.struct(
                s["kind"].alias("kind"), s["name"].alias("name"), s["line_start"].alias("line_start"), s["line_end"].alias("line_end"),
                s["params"].alias("params"), s["decorators"].alias("decorators"), s["bases"].alias("bases"), s["methods"].alias("methods"),
                (F.array_position(bound["names"], s["name"]) == i + 1).alias("is_first"),
                *([F.array_join(tx.slice_lines(bound["lines"], s["line_start"], s["line_end"]), tx.NL).alias("text")] if texts else []),
                *[F.lit(None).cast(kinds[c]).alias(c) for c in file_only])
        return F.concat(F.array(itself), F.transform("symbols", member))

    names = F.transform("symbols", lambda s: s["name"]).alias("names")
    bound = F.struct(tx.lines_of(F.col("content")).alias("lines"), names) if texts else F.struct(names)
    staged = tagged.withColumn("_members", tx.let(bound, members))
    rows = extract.rows_of(staged, "_members", "seq", "s", "repo_id", "path", "language", "side_effects", "control_flow")
    is_file = F.col("kind") == "file"
    flat = rows.select(
        "repo_id", "path", "language", "s.kind", F.col("seq").cast("int"), "s.name", "s.line_start", "s.line_end",
        "s.params", "s.decorators", "s.bases", "s.methods",
        *[f"s.{c}" for c in file_only], "side_effects", "control_flow", "s.is_first", *([F.col("s.text").alias("_source")] if texts else []),
        (F.col("s.line_end") - F.col("s.line_start") + 1).alias("_lines"))
    if texts:
        scored = complexity.with_complexity(flat, "_source", "language", "_lines", rules)
        flat = semantics.with_domain(scored, "name", "path", "_source", "domain")
    effect_types = F.transform("side_effects", lambda e: e["type"])
    staged = flat.select("*", semantics.role_of(F.col("name"), F.col("path")).alias("role"))
    summary = F.when(is_file, F.concat("language", F.lit(" file ("), F.col("line_end").cast("string"), F.lit(" lines)"))).otherwise(
        semantics.summary_of(semantics.symbol_base(F.col("kind"), F.col("methods"), F.col("bases")), F.when(F.col("kind") == "function", F.col("params")).otherwise(none),
                             F.col("decorators"), F.col("role"), F.col("domain"), effect_types))
    made = {"summary": summary, "id": paths.node_id(F.col("path"), F.when(is_file, F.lit("")).otherwise(F.col("name"))),
            "file_id": paths.node_id(F.col("path")), "ord": unit_ord()}
    return staged.select(*[made[c].alias(c) if c in made else F.col(c) for c in only])


def unit_ord() -> Column:
    rank = F.when(F.col("kind") == "file", 0).when(F.col("kind") == "function", 1).otherwise(2)
    return paths.node_ord(F.col("path"), rank, F.col("seq"))


#: Columns of units that the columns of nodes are made of, where they are not one of the same name.
_READ = {"type": ["kind"], "file_path": ["path"], "line_range": ["line_start", "line_end"], "tags": ["kind", "language", "decorators"],
         "semantics": ["kind", "side_effects", "control_flow", "domain", "role"]}


def read_by(node_columns: list) -> list:
    """Columns of units that ``nodes`` reads for these columns of its own."""
    return list(dict.fromkeys(["is_first", *[c for n in node_columns for c in _READ.get(n, [n])]]))


def nodes(unit_rows: DataFrame, only: list = None) -> DataFrame:
    """Node table: the first definition per id is kept. ``only`` names the columns to give (default: all)."""
    is_file = F.col("kind") == "file"
    sem = F.when(~is_file, F.struct(
        F.col("side_effects"), F.col("control_flow"), F.col("domain").alias("domain_hint"),
        F.col("role").alias("execution_role"), F.lit(0.0).alias("importance")).cast(SEMANTICS))
    made = {"type": F.col("kind"), "file_path": F.col("path"), "line_range": F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end")),
            "tags": F.when(is_file, F.array("language")).otherwise(F.col("decorators")), "semantics": sem}
    names = only or "repo_id id type name file_path line_range summary tags language complexity semantics ord".split()
    return unit_rows.where("is_first").select(*[made[c].alias(c) if c in made else F.col(c) for c in names])


def first_per_id(node_rows: DataFrame) -> DataFrame:
    """First node per id by ``ord``, for node rows that come from several places."""
    kept = [c for c in node_rows.columns if c not in ("repo_id", "id")]
    best = node_rows.groupBy("repo_id", "id").agg(F.min_by(F.struct(*kept), "ord").alias("_n"))
    return best.select("repo_id", "id", "_n.*").select(*node_rows.columns)


def _edge(src, dst, kind: str):
    return [F.col("repo_id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"),
            F.lit(gr.EDGE_WEIGHTS[kind]).alias("weight")]


def contains_edges(unit_rows: DataFrame) -> DataFrame:
    symbols = unit_rows.where((F.col("kind") != "file") & F.col("is_first"))
    return symbols.select(*_edge(F.col("file_id"), F.col("id"), "contains"))


def inherits_edges(unit_rows: DataFrame) -> DataFrame:
    """Class to base: the latest definition of the base name at or before the class.

    An as-of lookup over (repository, name) in definition order, run in blocks so a
    base name that half the corpus uses does not land in one task.
    """
    symbols = unit_rows.where(F.col("kind") != "file")
    bases = extract.rows_of(symbols.where(F.col("kind") == "class"), "bases", "_pos", "base", "repo_id", "id", "ord")
    asked = bases.select("repo_id", F.col("base").alias("name"), "ord", F.lit(1).alias("_turn"),
                         F.lit(None).cast("string").alias("def_id"), F.col("id").alias("class_id")).distinct()
    # Only names that some class refers to take part.
    defined = symbols.select("repo_id", "name", "ord", F.lit(0).alias("_turn"), F.col("id").alias("def_id"),
                             F.lit(None).cast("string").alias("class_id")).join(
        asked.select("repo_id", "name").distinct(), ["repo_id", "name"], "left_semi")
    resolved = latest_before(defined.unionByName(asked), ["repo_id", "name"], ["ord", "_turn"], "def_id", "base_id")
    hits = resolved.where(F.col("class_id").isNotNull() & F.col("base_id").isNotNull())
    return hits.select(*_edge(F.col("class_id"), F.col("base_id"), "inherits")).dropDuplicates(["repo_id", "src", "dst"])


def file_aliases(unit_rows: DataFrame) -> DataFrame:
    """Names under which a file can be imported; the last file in walk order wins."""
    files = unit_rows.where(F.col("kind") == "file")
    names = F.array_distinct(F.array(F.lower(paths.stem(F.col("name"))), F.lower(paths.without_suffix(F.col("path")))))
    rows = files.select("repo_id", "ord", F.col("id").alias("target"), F.explode(names).alias("alias"))
    return rows.groupBy("repo_id", "alias").agg(F.max_by("target", "ord").alias("target"))


def spellings(source) -> Column:
    """Lower-case spellings of an import source, in the order they are tried."""
    forms = [source, F.replace(source, F.lit("."), F.lit("/")), F.replace(source, F.lit("\\"), F.lit("/")),
             F.element_at(F.split(source, r"\."), -1), F.element_at(F.split(source, "/"), -1),
             F.element_at(F.split(source, r"\\"), -1)]
    return F.filter(F.array_distinct(F.transform(F.array(*forms), lambda s: F.lower(s))), lambda s: s != "")


def import_rows(unit_rows: DataFrame) -> DataFrame:
    files = unit_rows.where(F.col("kind") == "file")
    sources = F.array_distinct(F.transform("imports", lambda i: i["source"]))
    staged = files.select("repo_id", "id", sources.alias("_sources"))
    return extract.rows_of(staged, "_sources", "_pos", "source", "repo_id", "id").select(
        "repo_id", F.col("id").alias("file_id"), "source")


def imports_edges(unit_rows: DataFrame) -> DataFrame:
    """File to file. A source resolves the same way for every file of a repository, so
    each distinct source is resolved once and only then joined back to its importers."""
    rows = import_rows(unit_rows)
    tried = rows.select("repo_id", "source").distinct().select("repo_id", "source", F.posexplode(spellings(F.col("source"))).alias("pos", "alias"))
    resolved = (
        tried.join(file_aliases(unit_rows), ["repo_id", "alias"])
        .groupBy("repo_id", "source").agg(F.min_by("target", "pos").alias("target"))
    )
    hits = rows.join(resolved, ["repo_id", "source"]).where(F.col("target") != F.col("file_id"))
    return hits.select(*_edge(F.col("file_id"), F.col("target"), "imports")).dropDuplicates(["repo_id", "src", "dst"])


def callables(unit_rows: DataFrame) -> DataFrame:
    """Function names that can be a call target; the last function in node order wins."""
    fns = unit_rows.where((F.col("kind") == "function") & F.col("is_first")
                          & (F.length("name") >= gr.CALL_MIN_NAME) & ~F.col("name").isin(gr.CALL_STOP_NAMES))
    return fns.groupBy("repo_id", "name").agg(F.max_by(F.struct("id", "file_id"), "ord").alias("t")).select(
        "repo_id", F.col("name").alias("token"), F.col("t.id").alias("target"), F.col("t.file_id").alias("target_file"))


def calls_edges(unit_rows: DataFrame) -> DataFrame:
    """File to function. A file contains a function exactly when it is the function's
    own file, so the exclusion of contained targets is a column test, not a join."""
    tokens = extract.rows_of(unit_rows.where(F.col("kind") == "file"), "call_tokens", "_pos", "token", "repo_id", F.col("id").alias("file_id"))
    usable = tokens.where((F.length("token") >= gr.CALL_MIN_NAME) & ~F.col("token").isin(gr.CALL_STOP_NAMES))
    hits = usable.join(callables(unit_rows), ["repo_id", "token"]).where(F.col("target_file") != F.col("file_id"))
    return hits.select(*_edge(F.col("file_id"), F.col("target"), "calls"))


def edges(unit_rows: DataFrame) -> DataFrame:
    """All edges; every kind is distinct by itself, so no exchange over the union."""
    return (contains_edges(unit_rows).unionByName(inherits_edges(unit_rows))
            .unionByName(imports_edges(unit_rows)).unionByName(calls_edges(unit_rows)))


def distinct_edges(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.dropDuplicates(["repo_id", "src", "dst", "type"])


# ---- layers, modules, totals --------------------------------------------------


def layer_of(path, language) -> Column:
    comps = paths.parts(F.lower(path))
    col = None
    for layer, _, words in gr.LAYERS:
        test = F.arrays_overlap(comps, tx.lit_array(words))
        col = F.when(test, F.lit(layer)) if col is None else col.when(test, F.lit(layer))
    for layer, langs in gr.LANGUAGE_LAYERS.items():
        col = col.when(language.isin(langs), F.lit(layer))
    return col.otherwise(F.lit(gr.DEFAULT_LAYER))


def node_layers(node_rows: DataFrame) -> DataFrame:
    """Long form of layer membership."""
    return node_rows.select("repo_id", "id", layer_of(F.col("file_path"), F.col("language")).alias("layer_id"))


def layer_name(layer_id) -> Column:
    return tx.lookup({lid: name for lid, name, _ in gr.LAYERS}, layer_id)


def layer_sizes(node_layer: DataFrame) -> DataFrame:
    """Non-empty layers with their node counts; members stay in the long table."""
    return node_layer.groupBy("repo_id", "layer_id").agg(F.count("*").alias("nodes")).withColumn("name", layer_name(F.col("layer_id")))


def modules(node_rows: DataFrame) -> DataFrame:
    """Module of each file node: its first directory, ``root`` at the top."""
    comps = paths.parts(F.col("file_path"))
    return node_rows.where(F.col("type") == "file").select(
        "repo_id", "id", "file_path", F.when(F.size(comps) > 1, F.element_at(comps, 1)).otherwise(F.lit("root")).alias("module"))


def totals(node_rows: DataFrame, edge_rows: DataFrame, node_layer: DataFrame, top_languages: int = 8) -> DataFrame:
    """Report rows ``(repo_id, section, key, n)``: nodes per type, files per language, sizes."""
    def rows(df, section, key):
        return df.groupBy("repo_id", key.alias("key")).agg(F.count("*").alias("n")).select("repo_id", F.lit(section).alias("section"), "key", "n")

    langs = rows(node_rows.where(F.col("type") == "file"), "files", F.col("language"))
    top = first_rows(langs, ["repo_id"], [F.desc("n"), F.col("key")], top_languages).drop("rank")
    layers = node_layer.groupBy("repo_id").agg(F.count_distinct("layer_id").alias("n")).select(
        "repo_id", F.lit("graph").alias("section"), F.lit("layers").alias("key"), "n")
    return (rows(node_rows, "nodes", F.col("type")).unionByName(top)
            .unionByName(rows(node_rows, "graph", F.lit("nodes"))).unionByName(rows(edge_rows, "graph", F.lit("edges"))).unionByName(layers))
