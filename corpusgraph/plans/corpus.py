"""The jobs end to end: corpus to graph tables, storage, and refresh after a change."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.tables import written
from ..operators import build, importance, refresh
from ..rules import complexity as cx
from ..sources import files as fs


@dataclass(frozen=True)
class Graph:
    units: DataFrame
    nodes: DataFrame
    edges: DataFrame
    node_layer: DataFrame


def from_units(units: DataFrame) -> Graph:
    """Graph tables from unit rows, importance included."""
    edges = written(build.edges(units), "edges")
    nodes = importance.with_importance(build.nodes(units), edges)
    return Graph(units, nodes, edges, build.node_layers(nodes))


def build_graph(files: DataFrame, globs: DataFrame = None, rules=cx.DEFAULT_RULES) -> Graph:
    """Scan, extract in one pass over the text, resolve edges, score.

    Unit rows are written once: every edge kind reads them, none reads the text again.
    """
    scanned = fs.scan_files(files, globs)
    return from_units(written(build.units(scanned, rules), "units"))


def refresh_graph(old_units: DataFrame, old_fps: DataFrame, files: DataFrame, globs: DataFrame = None) -> Graph:
    """Graph after a change, or None when no fingerprint changed; only changed files are read again."""
    scanned = fs.scan_files(files, globs)
    diff = written(refresh.diff_fingerprints(old_fps, fs.fingerprints(scanned)), "diff")
    if refresh.unchanged(diff):
        return None
    return from_units(written(refresh.refreshed_units(old_units, scanned, diff), "units"))


def save(graph: Graph, path: str) -> None:
    """All tables as Parquet, ordered by repository so that scans of one repository prune."""
    for name in ("units", "nodes", "edges", "node_layer"):
        getattr(graph, name).repartitionByRange("repo_id", *(["src"] if name == "edges" else ["id"])).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(*(spark.read.parquet(f"{path}/{name}") for name in ("units", "nodes", "edges", "node_layer")))
