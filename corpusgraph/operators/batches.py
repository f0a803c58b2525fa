"""Summarisation batches and fact rollups. The summariser itself is an outside service:
its inputs (prompt rows) and its answers are tables."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import paths, text as tx
from ..functions.ordered import BLOCK, first_rows, into_blocks
from ..rules import graph as gr
from . import traverse as tv

NODE = ["repo_id", "id"]
FILES_PER_BATCH, NODES_PER_BATCH, CODE_CHARS, SNIPPET_CHARS = 15, 30, 15_000, 3_000
TOP_CALLERS, TOP_CALLEES, CONTEXT_CHARS = 2, 3, 80


# ---- selection ------------------------------------------------------------------


def enrichable(nodes: DataFrame) -> DataFrame:
    """Functions and classes in backend languages, outside test directories."""
    return nodes.where(
        F.col("type").isin("function", "class") & (F.col("file_path") != "") & F.col("language").isin(gr.ENRICH_LANGUAGES)
        & ~paths.overlaps(F.col("file_path"), gr.ENRICH_SKIP_PATHS))


def skipped_counts(nodes: DataFrame) -> DataFrame:
    symbol = F.col("type").isin("function", "class")
    return nodes.groupBy("repo_id").agg(
        F.count_if(symbol & F.col("language").isin(gr.CONFIG_LANGUAGES)).alias("config_frontend"),
        F.count_if(symbol & (F.col("file_path") != "") & paths.overlaps(F.col("file_path"), gr.ENRICH_SKIP_PATHS)).alias("tests"))


def priority() -> Column:
    """Sort text: complex before moderate before simple, classes before functions, then node order."""
    rank = F.when(F.col("complexity") == "complex", 0).when(F.col("complexity") == "moderate", 1).when(F.col("complexity") == "simple", 2).otherwise(3)
    kind = F.when(F.col("type") == "class", 0).otherwise(1)
    return F.concat(rank.cast("string"), kind.cast("string"), "ord")


def prioritized(rows: DataFrame, limit: int = 0) -> DataFrame:
    """Rows with their sort text; with a limit, the first rows per repository."""
    keyed = rows.withColumn("priority", priority())
    return first_rows(keyed, ["repo_id"], ["priority"], limit).drop("rank") if limit > 0 else keyed


# ---- packing --------------------------------------------------------------------
#
# Packing is a scan with a small state: (files, nodes) of the open batch. Files of one
# repository are cut into ordered blocks. Each block is first run from every possible
# state at once; the block results are then chained per repository, which gives each
# block its true start state; the last pass writes the batch numbers. No task ever
# sees more than one block of files.


def _states(files_cap, nodes_cap):
    return np.array([(f, n) for f in range(files_cap) for n in range(nodes_cap)])


def _transition(files_cap, nodes_cap):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start = _states(files_cap, nodes_cap)
        files, nodes, closed = start[:, 0].copy(), start[:, 1].copy(), np.zeros(len(start), dtype=np.int64)
        for n in pdf.sort_values("first")["n"].to_numpy():
            files += 1
            nodes += n
            full = (files >= files_cap) | (nodes >= nodes_cap)
            closed += full
            files[full] = 0
            nodes[full] = 0
        return pd.DataFrame({"repo_id": key[0], BLOCK: key[1], "start": start[:, 0] * nodes_cap + start[:, 1],
                             "end": files * nodes_cap + nodes, "closed": closed})

    return run


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    state, batch, rows = 0, 0, []
    for block, part in pdf.groupby(BLOCK, sort=True):
        rows.append((block, state, batch))
        hit = part[part["start"] == state].iloc[0]
        state, batch = int(hit["end"]), batch + int(hit["closed"])
    out = pd.DataFrame(rows, columns=[BLOCK, "start", "first_batch"])
    out.insert(0, "repo_id", pdf["repo_id"].iloc[0])
    return out


def _number(files_cap, nodes_cap):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        files, nodes = divmod(int(pdf["start"].iloc[0]), nodes_cap)
        batch, numbers = int(pdf["first_batch"].iloc[0]), []
        for n in pdf["n"].to_numpy():
            files, nodes = files + 1, nodes + int(n)
            numbers.append(batch)
            if files >= files_cap or nodes >= nodes_cap:
                batch, files, nodes = batch + 1, 0, 0
        return pd.DataFrame({"repo_id": pdf["repo_id"], "file_path": pdf["file_path"], "batch": numbers})

    return run


def packed(rows: DataFrame, files_cap: int = FILES_PER_BATCH, nodes_cap: int = NODES_PER_BATCH) -> DataFrame:
    """Batch number per prioritized row; a batch closes at ``files_cap`` files or ``nodes_cap`` nodes.

    Files come in the order of their first row.
    """
    files = rows.groupBy("repo_id", "file_path").agg(F.min("priority").alias("first"), F.count("*").alias("n"))
    blocks = into_blocks(files, ["repo_id"], ["first"])
    steps = blocks.select("repo_id", BLOCK, "first", "n").groupBy("repo_id", BLOCK).applyInPandas(
        _transition(files_cap, nodes_cap), f"repo_id string, {BLOCK} int, start long, end long, closed long")
    starts = steps.groupBy("repo_id").applyInPandas(_chain, f"repo_id string, {BLOCK} int, start long, first_batch long")
    numbered = blocks.join(starts, ["repo_id", BLOCK]).groupBy("repo_id", BLOCK).applyInPandas(
        _number(files_cap, nodes_cap), "repo_id string, file_path string, batch long")
    return rows.join(numbered, ["repo_id", "file_path"])


def with_snippets(rows: DataFrame, files: DataFrame, max_chars: int = SNIPPET_CHARS) -> DataFrame:
    """Source of each row, one line wider on both sides, cut at ``max_chars`` with a marker."""
    lines = tx.lines_of(F.col("content"))
    first, last = F.greatest(F.col("line_range.start") - 1, F.lit(1)), F.col("line_range.end") + 1
    text = F.array_join(tx.slice_lines(lines, first, F.least(last, F.size(lines))), tx.NL)
    source = files.select("repo_id", F.col("path").alias("file_path"), "content")
    cut = rows.join(source, ["repo_id", "file_path"]).withColumn("_text", text).drop("content")
    return cut.withColumn("snippet", F.when(F.length("_text") > max_chars, F.concat(F.substring("_text", 1, max_chars), F.lit("\n..."))).otherwise(F.col("_text"))).drop("_text")


def sized(batched: DataFrame) -> DataFrame:
    """What cutting needs of each row: its batch and place (``file_first``: the first row of its file) and its snippet's length."""
    whole = batched.where(F.col("repo_id").isNotNull() & F.col("file_path").isNotNull())
    return whole.select("repo_id", "batch", "id", F.min("priority").over(Window.partitionBy("repo_id", "file_path")).alias("file_first"),
                        "priority", F.length("snippet").alias("size"))


def cut(sizes: DataFrame, budget: int) -> DataFrame:
    """Prompt and item number of each row of ``sized``: the first snippet over the budget opens the next prompt.

    Batches are streamed in order; what is carried from row to row is the open prompt.
    """
    def run(parts):
        batch, prompt, used, item = None, 0, 0, 0
        for part in parts:
            prompts, items = [], []
            for key in zip(part.column("repo_id").to_pylist(), part.column("batch").to_pylist(), part.column("size").to_pylist()):
                size = key[2]
                if key[:2] != batch:
                    batch, prompt, used, item = key[:2], 0, 0, 0
                elif used + size > budget:
                    prompt, used, item = prompt + 1, 0, 0
                prompts.append(prompt)
                items.append(item)
                used, item = used + size, item + 1
            yield pa.RecordBatch.from_arrays([part.column("repo_id"), part.column("id"), pa.array(prompts, pa.int32()), pa.array(items, pa.int32())],
                                             names=["repo_id", "id", "prompt", "item"])

    ordered = sizes.repartition("repo_id", "batch").sortWithinPartitions("repo_id", "batch", "file_first", "priority", "id", "size")
    return ordered.select("repo_id", "batch", "id", "size").mapInArrow(run, "repo_id string, id string, prompt int, item int")


def prompts(batched: DataFrame, max_chars: int = CODE_CHARS, context_size: int = None) -> DataFrame:
    """Prompt and item number per row; the rows' snippets do not travel."""
    return cut(sized(batched), max_chars if context_size is None else min((context_size - 800) * 3, max_chars))


def context_lines(nodes: DataFrame, edges: DataFrame, scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(repo_id, id, context)``: most important callers and callees with short summaries."""
    rank = scored.select("repo_id", F.col("id").alias("other"), "importance")
    info = nodes.select("repo_id", F.col("id").alias("other"), F.concat(F.lit("  - "), "name", F.lit(": "), F.substring("summary", 1, CONTEXT_CHARS)).alias("text"))
    ids = wanted.select(*NODE)

    def side(rows, other, top, title):
        ranked = rows.withColumnRenamed(other, "other").join(rank, ["repo_id", "other"], "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
        picked = first_rows(ranked, NODE, [F.desc("importance"), F.col("other")], top).join(info, ["repo_id", "other"])
        return picked.groupBy(*NODE).agg(F.concat(F.lit(title + tx.NL), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), tx.NL)).alias(other))

    a = side(tv.callers(edges, ids), "caller", TOP_CALLERS, "Called by:")
    b = side(tv.callees(edges, ids), "callee", TOP_CALLEES, "Calls:")
    return a.join(b, NODE, "full_outer").select(*NODE, F.concat_ws(tx.NL, "caller", "callee").alias("context"))


def blocks_text(rows: DataFrame, context: DataFrame = None) -> DataFrame:
    """The text block of each row; ``item`` numbers the block within its prompt."""
    attr = lambda name, col: F.when(col != "", F.concat(F.lit(f' {name}="'), col, F.lit('"'))).otherwise(F.lit(""))
    start, end = F.col("line_range.start"), F.col("line_range.end")
    effects = F.transform("semantics.side_effects", lambda e: F.concat(e["type"], F.lit(" ("), F.format_string("%.1f", e["confidence"]), F.lit(")")))
    withc = rows.join(context, NODE, "left") if context is not None else rows.withColumn("context", F.lit(None).cast("string"))
    head = F.concat(F.lit('<FUNC id="f'), F.col("item").cast("string"), F.lit('" file="'), paths.file_name(F.col("file_path")), F.lit('"'),
                    attr("domain", tv.domain_of()), attr("role", tv.role_of()), F.lit(">"))
    lines = F.array_compact(F.array(
        head, F.concat(F.lit("Name: "), "name"),
        F.when(end > start, F.concat(F.lit("Lines: "), start, F.lit("-"), end, F.lit(" ("), end - start + 1, F.lit(" lines, "), "complexity", F.lit(")"))),
        F.when(F.size(effects) > 0, F.concat(F.lit("Side effects: "), F.array_join(effects, ", "))),
        F.when(F.size("semantics.control_flow") > 0, F.concat(F.lit("Control flow: "), F.array_join("semantics.control_flow", ", "))),
        F.concat(F.lit("Code:" + tx.NL), "snippet"), F.when(F.col("context") != "", F.col("context")), F.lit("</FUNC>")))
    return withc.withColumn("block", F.array_join(lines, tx.NL))


def content_token() -> Column:
    return F.concat("id", F.lit(":"), F.substring(F.md5("snippet"), 1, 10))


def prompt_ids(rows: DataFrame) -> DataFrame:
    """Stable id per prompt from its node ids, names and content tokens."""
    quoted = lambda c: F.to_json(F.array(c))
    bare = lambda c: F.substring(quoted(c), F.lit(2), F.length(quoted(c)) - 2)
    keyed = rows.select("repo_id", "batch", "prompt", F.struct(
        "item", bare(content_token()).alias("t"), F.concat(F.lit("["), bare(F.col("id")), F.lit(", "), bare(F.col("name")), F.lit("]")).alias("n")).alias("s"))
    grouped = keyed.groupBy("repo_id", "batch", "prompt").agg(F.array_sort(F.collect_list("s")).alias("s"))
    text = F.concat(F.lit('{"content_tokens": ['), F.array_join(F.transform("s", lambda s: s["t"]), ", "),
                    F.lit('], "nodes": ['), F.array_join(F.transform("s", lambda s: s["n"]), ", "), F.lit("]}"))
    return grouped.select("repo_id", "batch", "prompt", F.substring(F.md5(text), 1, 12).alias("prompt_id"), F.size("s").alias("items"))


def unanswered(ids: DataFrame, answers: DataFrame) -> DataFrame:
    return ids.join(answers.select("prompt_id").distinct(), "prompt_id", "left_anti")


# ---- answers ----------------------------------------------------------------------


def answer_map(raw) -> Column:
    """JSON object of an answer text as a map of its string values; null if there is none."""
    text = tx.strip(raw)
    fenced = F.startswith(text, F.lit("```"))
    bare = F.when(fenced, F.regexp_replace(F.regexp_replace(text, r"\A```\w*\n?", ""), r"\n?```\z", "")).otherwise(text)
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    parsed = F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner))
    fields = F.try_variant_get(parsed, "$", "map<string,variant>")
    texts = F.map_filter(fields, lambda k, v: F.schema_of_variant(v) == "STRING")
    return F.transform_values(texts, lambda k, v: F.try_variant_get(v, "$", "string"))


def answer_rows(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Summaries by node: ``(repo_id, id, summary)`` for every known item of an answer."""
    parsed = answers.select("prompt_id", F.explode_outer(answer_map(F.col("raw"))).alias("key", "summary")).where(F.col("key").isNotNull())
    keyed = items.select("prompt_id", *NODE, F.concat(F.lit("f"), F.col("item").cast("string")).alias("key"))
    return keyed.join(parsed, ["prompt_id", "key"]).select(*NODE, "summary")


def missing_items(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Items of answered prompts that the answer does not mention."""
    told = answers.select("prompt_id", F.explode_outer(F.map_keys(answer_map(F.col("raw")))).alias("key"))
    keyed = items.join(answers.select("prompt_id").distinct(), "prompt_id", "left_semi").select(
        "prompt_id", *NODE, F.concat(F.lit("f"), F.col("item").cast("string")).alias("key"))
    return keyed.join(told.where(F.col("key").isNotNull()), ["prompt_id", "key"], "left_anti")


def with_answers(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    found = summaries.select(*NODE, F.col("summary").alias("_s"))
    return nodes.join(found, NODE, "left").withColumn("summary", F.coalesce("_s", "summary")).drop("_s")


# ---- facts ------------------------------------------------------------------------


def fact_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts of each file from the symbols it contains: ``(repo_id, file_id, key, value)``, distinct."""
    symbols = nodes.where(F.col("type").isin("function", "class")).select(
        "repo_id", F.col("id").alias("dst"), tv.effect_types(nodes).alias("effects"), tv.domain_of().alias("domain"))
    files = nodes.where(F.col("type") == "file").select("repo_id", F.col("id").alias("src"))
    inside = edges.where(F.col("type") == "contains").join(files, ["repo_id", "src"], "left_semi").join(symbols, ["repo_id", "dst"])

    def of_effect(e):
        prefix, entity = F.substring_index(e, ":", 1), F.substring(e, F.instr(e, ":") + 1, F.length(e))
        named = F.contains(e, F.lit(":"))
        return F.array_compact(F.array(
            F.struct(F.lit("side_effects").alias("key"), F.when(named, prefix).otherwise(e).alias("value")),
            F.when(named & F.contains(prefix, F.lit("api")), F.struct(F.lit("external_apis").alias("key"), entity.alias("value"))),
            F.when(named & ~F.contains(prefix, F.lit("api")) & F.contains(prefix, F.lit("db")), F.struct(F.lit("db_tables").alias("key"), entity.alias("value")))))

    facts = F.concat(F.flatten(F.transform("effects", of_effect)),
                     F.when(F.col("domain") != "", F.array(F.struct(F.lit("domains").alias("key"), F.col("domain").alias("value"))))
                     .otherwise(F.array().cast("array<struct<key:string,value:string>>")))
    return inside.select("repo_id", F.col("src").alias("file_id"), F.explode_outer(facts).alias("f")).where(F.col("f").isNotNull()).select(
        "repo_id", "file_id", "f.key", "f.value").distinct()


def fact_maps(rows: DataFrame, by: list) -> DataFrame:
    """Sorted distinct values per key as one map per group (groups are files or modules)."""
    per_key = rows.groupBy(*by, "key").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return per_key.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "values")))).alias("facts"))


def merged_facts(maps: DataFrame, by: list) -> DataFrame:
    """Union of fact maps per group, each key sorted and distinct."""
    rows = maps.select(*by, F.explode("facts").alias("key", "_values")).select(*by, "key", F.explode("_values").alias("value"))
    return fact_maps(rows, by)


def restored_facts(original, told) -> Column:
    """Told facts plus what they lost of the original ones, appended in sorted order."""
    none = F.array().cast("array<string>")
    keys = F.array_union(F.map_keys(told), F.map_keys(original))
    values = F.transform(keys, lambda k: F.concat(
        F.coalesce(F.try_element_at(told, k), none),
        F.array_sort(F.array_except(F.coalesce(F.try_element_at(original, k), none), F.coalesce(F.try_element_at(told, k), none)))))
    return F.map_from_arrays(keys, values)


def file_rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Child lines of files that hold at least one summary that was not generated."""
    children = nodes.where(F.col("type").isin("function", "class")).select("repo_id", F.col("id").alias("dst"), "name", "summary", "ord")
    files = nodes.where(F.col("type") == "file").select("repo_id", F.col("id").alias("file_id"), "file_path")
    inside = edges.where(F.col("type") == "contains").select("repo_id", F.col("src").alias("file_id"), "dst").join(children, ["repo_id", "dst"])
    told = (tx.strip(F.col("summary")) != "") & ~F.startswith("summary", F.lit("Function"))
    rows = inside.join(inside.where(told).select("repo_id", "file_id").distinct(), ["repo_id", "file_id"], "left_semi")
    return rows.join(files, ["repo_id", "file_id"]).where(F.col("summary") != "").select(
        "repo_id", "file_id", "file_path", "ord", F.concat(F.lit("- "), "name", F.lit(": "), F.substring("summary", 1, 100)).alias("line"))


def module_rollup(modules: DataFrame, nodes: DataFrame, file_facts: DataFrame):
    """File lines per module, and the merged facts of its files."""
    summary = nodes.select(*NODE, "summary", "ord")
    generated = F.startswith("summary", F.lit("python file")) | F.startswith("summary", F.lit("javascript file"))
    rows = modules.join(summary, NODE)
    lines = rows.where((F.col("summary") != "") & ~generated).select(
        "repo_id", "module", "ord", F.concat(F.lit("- "), "file_path", F.lit(": "), F.substring("summary", 1, 100)).alias("line"))
    facts = merged_facts(rows.select("repo_id", "module", F.col("id").alias("file_id")).join(file_facts, ["repo_id", "file_id"]), ["repo_id", "module"])
    return lines, facts.join(lines.select("repo_id", "module").distinct(), ["repo_id", "module"], "left_semi")
