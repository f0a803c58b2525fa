"""Graph queries: neighbours, search, bounded impact, shortest flow, chains, detail.

Edges are ``(repo_id, src, dst, type, weight)``; node sets are ``(repo_id, id)`` with a
key column of the caller's choice, so many questions run as one job.
"""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import first_rows
from ..functions.tables import written
from .search import FOLLOWED, NODE, impact, neighbours, shortest_paths  # noqa: F401


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``(repo_id, id, caller)`` for each wanted node, in long form."""
    e = edges.where(F.col("type") == "calls").select("repo_id", F.col("dst").alias("id"), F.col("src").alias("caller"))
    return e.join(targets.select(*NODE).distinct(), NODE, "left_semi")


def callees(edges: DataFrame, sources: DataFrame) -> DataFrame:
    e = edges.where(F.col("type") == "calls").select("repo_id", F.col("src").alias("id"), F.col("dst").alias("callee"))
    return e.join(sources.select(*NODE).distinct(), NODE, "left_semi")


def effect_types(nodes: DataFrame):
    """Effect names of a node row; empty for files."""
    return F.coalesce(F.transform("semantics.side_effects", lambda e: e["type"]), F.array().cast("array<string>"))


def domain_of():
    return F.coalesce(F.col("semantics.domain_hint"), F.lit(""))


def role_of():
    return F.coalesce(F.col("semantics.execution_role"), F.lit(""))


def find(nodes: DataFrame, type: str = None, domain: str = None, effect: str = None, name: str = None,
         limit: int = None) -> DataFrame:
    """Conjunctive attribute search; an effect matches in full or by its family. ``limit`` is a number per repository."""
    hits = nodes
    if type:
        hits = hits.where(F.col("type") == type)
    if domain:
        hits = hits.where(domain_of() == domain)
    if effect:
        hits = hits.where(F.exists(effect_types(nodes), lambda e: (e == effect) | (F.element_at(F.split(e, ":"), 1) == effect)))
    if name:
        hits = hits.where(F.contains(F.lower("name"), F.lit(name.lower())))
    return first_rows(hits, ["repo_id"], ["ord", "id"], limit).drop("rank") if limit else hits


def resolved_names(nodes: DataFrame) -> DataFrame:
    """Node id per name; the last node in order wins."""
    return nodes.groupBy("repo_id", "name").agg(F.max_by("id", "ord").alias("id"))


def named(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Ids for ``(repo_id, name)`` rows."""
    wanted = nodes.select("repo_id", "name", "id", "ord").join(names.select("repo_id", "name").distinct(), ["repo_id", "name"], "left_semi")
    return resolved_names(wanted)


def one_hop(members: DataFrame, edges: DataFrame, key: str = "set_id", kinds=FOLLOWED) -> DataFrame:
    """A set and its direct neighbours, distinct."""
    own = members.select(key, *NODE)
    reached = own.join(neighbours(edges, kinds), NODE).select(key, "repo_id", F.col("next").alias("id"))
    return own.unionByName(reached).distinct()


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in a node set."""
    ids = members.select(*NODE).distinct()
    return (
        edges.join(ids.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi")
        .join(ids.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi")
    )


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select("repo_id", F.explode(F.array("src", "dst")).alias("id"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with at least one edge."""
    return nodes.join(endpoints(edges).distinct(), NODE, "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """Number of edge ends per node."""
    return endpoints(edges).groupBy(*NODE).agg(F.count("*").alias("degree"))


def edge_detail(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, limit: int = 30) -> DataFrame:
    """First ``limit`` incoming and outgoing edges of wanted nodes, with the total per direction."""
    ids = wanted.select(*NODE).distinct()
    both = edges.select("repo_id", F.col("dst").alias("id"), F.col("src").alias("other"), "type", F.lit("in").alias("direction")).unionByName(
        edges.select("repo_id", F.col("src").alias("id"), F.col("dst").alias("other"), "type", F.lit("out").alias("direction")))
    own = both.join(ids, NODE, "left_semi")
    total = own.groupBy(*NODE, "direction").agg(F.count("*").alias("total"))
    names = nodes.select("repo_id", F.col("id").alias("other"), F.col("name").alias("other_name"))
    listed = first_rows(own, [*NODE, "direction"], ["type", "other"], limit)
    return listed.join(total, [*NODE, "direction"]).join(names, ["repo_id", "other"])


def explain(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, names_shown: int = 10) -> DataFrame:
    """Attributes of wanted nodes with caller and callee names.

    The listing shows the first names by id and how many there are; hub nodes with
    millions of callers never gather more than the shown names.
    """
    base = nodes.join(wanted.select(*NODE).distinct(), NODE, "left_semi")
    name_of = nodes.select("repo_id", F.col("id").alias("other"), F.col("name").alias("other_name"))

    def listing(rows, other, out):
        named_rows = rows.withColumnRenamed(other, "other").join(name_of, ["repo_id", "other"])
        count = named_rows.groupBy(*NODE).agg(F.count("*").alias(f"{out}_total"))
        shown = first_rows(named_rows, NODE, ["other"], names_shown).groupBy(*NODE).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "other_name"))), lambda s: s["other_name"]).alias(out))
        return count.join(shown, NODE)

    ids = base.select(*NODE)
    return (
        base.join(listing(callers(edges, ids), "caller", "callers"), NODE, "left")
        .join(listing(callees(edges, ids), "callee", "callees"), NODE, "left")
        .withColumn("callers_total", F.coalesce("callers_total", F.lit(0)))
        .withColumn("callees_total", F.coalesce("callees_total", F.lit(0)))
    )


# ---- limited call chains --------------------------------------------------------


def branch_edges(nodes: DataFrame, edges: DataFrame, branches: int = 3) -> DataFrame:
    """First ``branches`` callees per node in target order, among existing nodes."""
    known = nodes.select("repo_id", F.col("id").alias("dst"), F.col("ord").alias("dst_ord"))
    calls = edges.where(F.col("type") == "calls").select("repo_id", "src", "dst")
    sources = nodes.select("repo_id", F.col("id").alias("src"))
    usable = calls.join(known, ["repo_id", "dst"]).join(sources, ["repo_id", "src"], "left_semi")
    return first_rows(usable, ["repo_id", "src"], ["dst_ord", "dst"], branches).select("repo_id", "src", "dst", "rank")


def _walk(entry, hops: list, max_nodes: int, max_depth: int) -> list:
    """Pre-order walk of one entry's small neighbourhood, ``(rank, src, dst)`` in order, with a shared visited set."""
    nexts = {}
    for _, src, dst in hops:
        nexts.setdefault(src, []).append(dst)
    chain, seen, stack = [], set(), [(entry, 0)]
    while stack and len(chain) < max_nodes:
        node, depth = stack.pop()
        if node in seen or depth > max_depth:
            continue
        seen.add(node)
        chain.append(node)
        stack.extend((n, depth + 1) for n in reversed(nexts.get(node, [])) if n not in seen)
    return chain


def _walked(max_nodes: int, max_depth: int):
    """Walks of a batch of entries, each with its array of hops."""
    @F.arrow_udf("array<string>")
    def walked(entries: pa.Array, hops: pa.Array) -> pa.Array:
        flat = hops.flatten()
        rows = list(zip(*(flat.field(k).to_pylist() for k in range(3))))
        out, at = [], 0
        for entry, size in zip(entries.to_pylist(), pc.list_value_length(hops).to_pylist()):
            out.append(_walk(entry, rows[at:at + size], max_nodes, max_depth))
            at += size
        return pa.array(out, pa.list_(pa.string()))

    return walked


def chains(entries: DataFrame, nodes: DataFrame, edges: DataFrame, max_nodes: int = 6, max_depth: int = 6,
           branches: int = 3) -> DataFrame:
    """Limited call chain per entry: rows ``(repo_id, entry, step, id)``.

    Neighbourhoods are gathered by one chain of joins over the entries' paths; with at most three branches and six levels one
    entry sees at most 1,092 edges, so an entry and its edges are one row; a batch of such rows is walked at once.
    """
    allowed = written(branch_edges(nodes, edges, branches), "branches")
    paths = entries.select("repo_id", F.col("id").alias("entry"), F.col("id").alias("n0")).distinct()
    depth = min(max_depth, max_nodes - 1)
    for k in range(1, depth + 1):
        step = allowed.select("repo_id", F.col("src").alias(f"n{k - 1}"), F.col("dst").alias(f"n{k}"), F.col("rank").alias(f"r{k}"))
        paths = paths.join(step, ["repo_id", f"n{k - 1}"], "left")
    hops = F.array(*[F.struct(F.col(f"r{k}").alias("rank"), F.col(f"n{k - 1}").alias("src"), F.col(f"n{k}").alias("dst")) for k in range(1, depth + 1)])
    seen = paths.select("repo_id", "entry", F.explode_outer(F.filter(hops, lambda h: h["dst"].isNotNull())).alias("h"))
    gathered = seen.groupBy("repo_id", "entry").agg(F.array_sort(F.collect_set("h")).alias("hops"))
    walked = gathered.select("repo_id", "entry", _walked(max_nodes, max_depth)("entry", "hops").alias("chain"))
    return walked.select("repo_id", "entry", F.posexplode("chain").alias("step", "id"))
