"""Tables that are small as files only are not broadcast; nodes settled by a few of their callers."""

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import tables
from corpusgraph.operators import change_impact as ci, importance as im, traverse as tv

from test_graph import brute_callers

BY_FILES, BY_ROWS = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@pytest.fixture
def thresholds(spark):
    """The session's thresholds as Spark starts with, and as they were afterwards."""
    before = {key: spark.conf.get(key, None) for key in (BY_FILES, BY_ROWS)}
    spark.conf.unset(BY_FILES), spark.conf.unset(BY_ROWS)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def planned(df) -> str:
    """The plan before any stage has run."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_nodes_are_not_broadcast_by_their_files_size(spark, thresholds):
    ids = F.concat(F.lit("P"), F.col("id").cast("string"))
    rows = spark.range(1_000_000).select(F.lit("r").alias("repo_id"), ids.alias("id"), ids.alias("file_path"), F.lit("function").alias("type"), F.col("id").alias("ord"))
    nodes = tables.written(rows, "nodes", compression="zstd")
    edges = spark.range(10).select(F.lit("r").alias("repo_id"), ids.alias("src"), F.concat(F.lit("P"), F.col("id") + 1).alias("dst"), F.lit("calls").alias("type"))
    paths = spark.range(3).select(F.lit("r").alias("repo_id"), F.when(F.col("id") > 0, ids).otherwise(F.lit("gone")).alias("path"))
    assert "BroadcastHashJoin" in planned(ci.unmapped_paths(nodes, paths))
    tables.tune(spark)
    assert "Broadcast" not in planned(ci.unmapped_paths(nodes, paths))
    assert [r.path for r in ci.unmapped_paths(nodes, paths).collect()] == ["gone"]
    assert tv.branch_edges(nodes, edges).count() == 10
    few = tables.written(paths, "paths")
    assert "BroadcastHashJoin" in planned(nodes.join(few, (nodes["repo_id"] == few["repo_id"]) & (nodes["file_path"] == few["path"])))


def test_thresholds_of_the_session(spark, thresholds):
    number = lambda key: int(spark.conf.get(key).removesuffix("b"))
    for _ in range(2):
        tables.tune(spark)
        assert (number(BY_FILES), number(BY_ROWS)) == (tables.SENT_BYTES, 10 << 20)
    spark.conf.set(BY_FILES, "-1"), spark.conf.unset(BY_ROWS)
    tables.tune(spark)
    assert (number(BY_FILES), number(BY_ROWS)) == (-1, -1)


@pytest.fixture
def followed(monkeypatch):
    """How often the calls of open nodes were followed one by one."""
    seen, follow = [], im._followed
    monkeypatch.setattr(im, "_followed", lambda *a: seen.append(1) or follow(*a))
    return seen


def counted(spark, calls):
    edges = spark.createDataFrame([("r", a, b, "calls") for a, b in calls], "repo_id string, src string, dst string, type string")
    return {r.id: (r.direct, min(r.indirect, im.CALLER_CAP)) for r in im.caller_counts(edges).collect()}


def test_few_callers_settle_a_star(spark, followed):
    """Customers call orders, orders parts, parts suppliers: no call is followed."""
    calls = {(f"C{o % 90}", f"O{o}") for o in range(300)} | {(f"O{o}", f"P{o * k % 17}") for o in range(300) for k in (1, 5)} | {(f"P{p}", f"S{p % 2}") for p in range(17)}
    assert counted(spark, calls) == brute_callers(calls) and not followed


def test_open_nodes_are_followed(spark, followed):
    """Nulls, a node that calls itself, two that call each other, one with a single indirect caller."""
    calls = {("a", "a"), ("b", "c"), ("c", "b"), ("x", "y"), ("y", "z"), ("d", "d"), ("e", "d")}
    assert counted(spark, calls) == brute_callers(calls) and followed
    assert counted(spark, {(None, "a"), ("a", "b"), ("q", None), (None, None)}) == {"a": (1, 0), "b": (1, 1), None: (2, 0)}
