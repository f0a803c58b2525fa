"""Units of chosen columns, splits of the code corpus, matches of the lexer."""

from corpusgraph.functions import lexer
from corpusgraph.operators import build, extract as xt
from workload import q_batches, q_graph, views

FILES = [("r", "a/f1.py", "python", "import os\n\ndef one(self, a, b):\n    if a:\n        repo.save(a)\n    return two(b)\n\nclass C(D):\n    def go(self):\n        return one(1)\n"),
         ("r", "b/f2.js", "javascript", "import { x } from './f1'\nexport function two(a) {\n  return one(a)\n}\nfunction two(a) {\n}\nexport class E extends C {\n}\n"),
         ("r", "c/f3.go", "go", ""), ("r", "c/f4.txt", "text", "function no() {}"), (None, None, "php", None)]


def test_units_of_chosen_columns(spark):
    files = spark.createDataFrame(FILES, "repo_id string, path string, language string, content string")
    whole = build.units(files).localCheckpoint()
    node_columns = [q_batches.CHOSEN, q_batches.ORDERED, ["repo_id", "id", "summary"]]
    for only in [q_graph.LINKED, *map(build.read_by, node_columns), *[[c] for c in build.UNIT]]:
        assert sorted(map(repr, build.units(files, only=only).collect())) == sorted(map(repr, whole.select(*only).collect())), only
    for only in node_columns:
        got = build.nodes(build.units(files, only=build.read_by(only)), only)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, build.nodes(whole).select(*only).collect())), only


def test_no_texts_for_queries_without_tags(spark):
    """Lines of symbols are neither cut nor joined where no tag is read."""
    files = spark.createDataFrame(FILES, "repo_id string, path string, language string, content string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(content" in plan(build.units(files))
    assert "split(content" not in plan(build.units(files, only=q_graph.LINKED))
    chosen = plan(build.nodes(build.units(files, only=build.read_by(q_batches.CHOSEN)), q_batches.CHOSEN))
    assert "split(content" not in chosen and "call_tokens" not in chosen


def test_splits_grow_with_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "SPLIT", 10)
    spark.range(95).selectExpr("id as o_orderkey", "id as o_custkey", "date'2020-01-01' as o_orderdate", "'1-URGENT' as o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    files = views.code_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 10
    assert files.select("path").distinct().count() == 95


def test_matches_by_name():
    code = "export const f = (x) => {\n}\nclass A extends B {\n}\nimport y from 'z'\n"
    hits = lexer.Scan([code, "no"], ["javascript", "text"], xt.rule_rows()).hits
    assert [(h["family"], h["pos"], h["line"], h["end"], h["name"], h["bases"], h["groups"]) for h in hits[0]] == [
        ("function", 1, 1, 2, "f", "", []), ("class", 0, 3, 4, "A", "B", []), ("import", 0, 5, 5, "", "", ["", "y", "z"]), ("export", 0, 1, 1, "", "", ["f"])]
    assert hits[1] == []
