"""A corpus on disk, scanned, built, saved, changed and refreshed; and a stream of changes."""

from corpusgraph.plans import corpus
from corpusgraph.sources import files as fs


def test_tree_to_graph_and_refresh(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"src/a.py": b"import b\ndef alpha(x):\n    return beta(x)\n", "src/b.py": b"def beta(x):\r\n    return 1\r\n",
                       "node_modules/c.js": b"function gone() {}\n", "src/.hidden/d.py": b"def hid(): pass\n", "bad.py": b"def caf\xff\xc3\xa9(): pass\n",
                       "notes.xyz": b"?", "skip_me.py": b"def skipped(): pass\n"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text)
    globs = spark.createDataFrame([("r", "skip*")], "repo_id string, glob string")
    files = fs.read_tree(spark, str(root), "r")
    graph = corpus.build_graph(files, globs)
    names = {(r.file_path, r.name) for r in graph.nodes.collect()}
    assert names == {("src/a.py", "a.py"), ("src/a.py", "alpha"), ("src/b.py", "b.py"), ("src/b.py", "beta"), ("bad.py", "bad.py"), ("bad.py", "café")}
    assert {r.type for r in graph.edges.collect()} == {"contains", "imports", "calls"}
    beta = [r for r in graph.nodes.collect() if r.name == "beta"][0]
    assert beta.line_range.end == 2 and beta.semantics.importance == 1.0

    corpus.save(graph, str(tmp_path / "out"))
    stored = corpus.load(spark, str(tmp_path / "out"))
    old_fps = spark.createDataFrame(fs.fingerprints(fs.scan_files(files, globs)).collect(), "repo_id string, path string, fp string")
    assert corpus.refresh_graph(stored.units, old_fps, files, globs) is None
    (root / "src/b.py").write_bytes(b"def beta2(x):\n    return 11\n")
    after = corpus.refresh_graph(stored.units, old_fps, fs.read_tree(spark, str(root), "r"), globs)
    assert {r.name for r in after.nodes.collect()} == {"a.py", "alpha", "b.py", "beta2", "bad.py", "café"}
    assert after.edges.where("type = 'calls'").count() == 0


def test_changes_of_one_path_in_one_trigger(spark, tmp_path):
    from corpusgraph.streaming import changes as sc
    source, state = f"{tmp_path}/changes", f"{tmp_path}/state"
    put = lambda rows: spark.createDataFrame(rows, sc.CHANGE).coalesce(1).write.mode("append").parquet(source)
    put([("r", "x.js", "function old() {\n}\n", "javascript", "added", 1), ("r", "y.js", "function y() {\n}\n", "javascript", "added", 1)])
    put([("r", "x.js", "function new_() {\n}\n", "javascript", "modified", 2), ("r", "y.js", None, "javascript", "removed", 2)])
    sc.run_available(spark, source, state)
    names = lambda at: sorted(r.name for r in sc.current_units(spark, at).where("kind = 'function'").collect())
    assert names(state) == ["new_"]
    put([("r", "z.js", "function z() {\n}\n", "javascript", "added", 3)])
    sc.run_available(spark, source, state)
    sc.compact(spark, state, f"{tmp_path}/compact")
    assert names(state) == names(f"{tmp_path}/compact") == ["new_", "z"]


def test_late_changes_lose(spark, tmp_path):
    from corpusgraph.streaming import changes as sc
    state = f"{tmp_path}/state"

    def apply(batch, *rows, to=state):
        df = spark.createDataFrame([("r", path, f"def {name}():\n    pass\n", "python", status, seq) for path, name, status, seq in rows], sc.CHANGE)
        sc.apply_batch(df, batch, to)

    def names(of):
        return sorted(r.name for r in sc.current_units(spark, of).where("kind = 'function'").collect())

    apply(0, ("a.py", "newer", "modified", 9), ("b.py", "gone", "added", 2), ("c.py", "first", "added", 1))
    apply(1, ("a.py", "older", "modified", 3), ("b.py", "gone", "removed", 5), ("c.py", "unknown", "modified", None))
    assert names(state) == ["first", "newer"]
    sc.compact(spark, state, f"{state}-compact")
    assert names(f"{state}-compact") == ["first", "newer"]
    apply(2, ("b.py", "back", "modified", 4), ("a.py", "late", "modified", 8), ("c.py", "second", "modified", 1), to=f"{state}-compact")
    assert names(f"{state}-compact") == ["newer", "second"]     # equal seq: the later batch
    apply(3, ("b.py", "back", "added", 6), to=f"{state}-compact")
    assert names(f"{state}-compact") == ["back", "newer", "second"]
