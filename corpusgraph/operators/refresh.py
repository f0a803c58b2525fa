"""Incremental refresh: snapshot diff, table merges, re-extraction of changed files only."""

from pyspark.sql import DataFrame, functions as F

from . import build

PATH = ["repo_id", "path"]
NODE = ["repo_id", "id"]
EDGE = ["repo_id", "src", "dst", "type"]


def diff_fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(repo_id, path, status)`` for added, modified and removed paths."""
    a = old.select(*PATH, F.col("fp").alias("_old"))
    b = new.select(*PATH, F.col("fp").alias("_new"))
    status = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
              .when(F.col("_old") != F.col("_new"), "modified"))
    return a.join(b, PATH, "full_outer").select(*PATH, status.alias("status")).where(F.col("status").isNotNull())


def unchanged(diff: DataFrame) -> bool:
    """True when a refresh has nothing to do; stops at the first changed path."""
    return diff.isEmpty()


def merge_nodes(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Old nodes outside changed files, plus the new ones; a new node wins by id."""
    paths = changed.select("repo_id", F.col("path").alias("file_path")).distinct()
    kept = old.join(paths, ["repo_id", "file_path"], "left_anti").join(new.select(*NODE), NODE, "left_anti")
    return kept.select(*new.columns).unionByName(new)


def merge_edges(old: DataFrame, new: DataFrame, old_nodes: DataFrame, merged_nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Old edges that do not start in a changed file and are not stated again, plus the
    new ones; edges of nodes that no longer exist are dropped."""
    paths = changed.select("repo_id", F.col("path").alias("file_path")).distinct()
    stale = old_nodes.join(paths, ["repo_id", "file_path"], "left_semi").select("repo_id", F.col("id").alias("src"))
    kept = old.join(stale, ["repo_id", "src"], "left_anti").join(new.select(*EDGE), EDGE, "left_anti")
    alive = merged_nodes.select(*NODE)
    return (
        kept.select(*new.columns).unionByName(new)
        .join(alive.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi")
        .join(alive.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi")
    )


def merge_file_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Path to id table; new entries win."""
    return old.join(new.select(*PATH), PATH, "left_anti").select(*new.columns).unionByName(new)


def refreshed_units(old_units: DataFrame, files: DataFrame, diff: DataFrame) -> DataFrame:
    """Unit rows after a change: only added and modified files are extracted again."""
    fresh = files.join(diff.where("status <> 'removed'").select(*PATH), PATH, "left_semi")
    kept = old_units.join(diff.select(*PATH), PATH, "left_anti")
    return kept.unionByName(build.units(fresh))
