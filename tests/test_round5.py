"""Queries over files and the graph compute and move what they read, not more."""

import re

import pytest

import __spark_entry__  # noqa: F401
from workload import q_batches, q_graph, views

TABLES = {
    "region": ("r_regionkey long, r_name string", [(0, "ASIA")]),
    "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "CHINA", 0), (1, "INDIA", 0)]),
    "customer": ("c_custkey long, c_name string, c_nationkey long, c_mktsegment string", [(1, "c1", 0, "A"), (2, "c2", 1, "B")]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(1, "s1", 0), (2, "s2", 1)]),
    "part": ("p_partkey long, p_name string, p_type string", [(1, "p1", "T"), (2, "p2", "T")]),
    "orders": ("o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string", [(k, 1 + k % 2, "2020-01-01", "1-URGENT") for k in range(16)]),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(1, 1, 1), (1, 1, 1), (1, 1, 2), (2, 1, 1), (2, None, 1), (2, None, 1), (None, 2, 2), (11, 1, 1)]),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_call_edges_are_distinct_by_their_keys(spark, folder):
    edges = views.view(spark, folder, "star_edges")
    inputs = {n: views.view(spark, folder, n) for n in views.refs(views.SHARED["star_edges"], set(views.TABLES))}
    key = lambda df: sorted(df.collect(), key=repr)
    assert key(edges) == key(spark.sql(views.SHARED["star_edges"], **inputs))
    assert len(re.findall(r"Aggregate \[l_\w+#\d+L, l_\w+#\d+L\]", optimized(edges))) == 2, optimized(edges)


def test_stored_units_hold_no_tags(spark, folder):
    columns = q_graph.unit_rows(spark, folder).columns
    assert {"imports", "call_tokens", "bases"} <= set(columns) and not {"side_effects", "domain", "complexity", "summary"} & set(columns)
    placed = q_batches.batched(spark, folder)
    assert "semantics" not in placed.columns and placed.count() > 0


def test_nodes_are_filtered_before_they_are_tagged(spark, folder):
    plan = optimized(q_batches.k1(spark, folder))
    # no pattern of an effect or of complexity is left, and languages are picked where the files are read
    assert "regexp_count" not in plan and "side_effects" not in plan, plan
    assert plan.index("Generate") < plan.rindex("Filter"), plan
    got = {(r.repo_id, r.id) for r in q_batches.k1(spark, folder).collect()}
    full = {(r.repo_id, r.id) for r in q_batches.bt.enrichable(q_graph.build.nodes(q_batches.units(spark, folder).localCheckpoint())).collect()}
    assert got == full and got
