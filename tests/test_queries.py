"""The registered queries against their SQL twins on the smallest tables."""

import importlib
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from workload.views import TABLES

SF = "/root/testdata/sf0.001"
PICKED = ["a2_a5_scan", "b6_python_symbols", "c8_summaries", "e7_edges", "f5_impact", "f15_percentiles", "g1_snapshot_diff",
          "h7_report", "i5_tour", "j8_chunk_contents", "k4_batches", "k11_answers", "l7_precedence", "m1_retrieve"]


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
@pytest.mark.parametrize("name", PICKED)
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = [r.asDict() for r in entry.queries()[name](spark, SF).collect()]
    rel = con.execute(entry.oracle_sql()[name])
    cols = sorted(d[0] for d in rel.description)
    order = [d[0] for d in rel.description]
    want = [dict(zip(order, r)) for r in rel.fetchall()]
    assert got and sorted(got[0]) == cols
    key = lambda rows: sorted(([plain(r[c]) for c in cols] for r in rows), key=repr)
    assert key(got) == key(want)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_entry_without_the_training_data_subpackage(monkeypatch):
    with monkeypatch.context() as m:
        m.setitem(sys.modules, "corpusgraph.llm", None)
        m.delitem(sys.modules, "corpusgraph.llm.queries", raising=False)
        importlib.reload(entry)
        assert entry.llm is None and "f7_shortest_path" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    importlib.reload(entry)
