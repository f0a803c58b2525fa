"""Headline jobs at one scale; prints one JSON line.

Inputs: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).
The corpus and the star graph are stored once, as they would be in use; each job is then
timed end to end into a sink that keeps nothing.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F  # noqa: E402


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from corpusgraph.functions.tables import tune, written
    from corpusgraph.operators import batches, build, export, extract, importance, refresh, reports, semantics, traverse
    from corpusgraph.sources import files as fs
    from workload import views

    tune(spark)
    seconds = {}

    def timed(name, job):
        start = time.time()
        out = job()
        if out is not None:
            out.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)

    files = written(views.code_files(spark, sf), "bench-files")
    nodes = written(views.star_nodes(spark, sf), "bench-nodes")
    edges = written(views.star_edges(spark, sf), "bench-edges")
    n_files, n_edges = files.count(), edges.count()

    held = {}

    def units():
        held["units"] = written(build.units(files), "bench-units")

    timed("fingerprints", lambda: fs.fingerprints(files))
    timed("semantic_tags", lambda: semantics.file_semantics(extract.extracted(files)).select("repo_id", "path", "side_effects", "control_flow"))
    timed("units_all_in_one", units)
    timed("edges", lambda: build.edges(held["units"]))
    timed("calls_ranked", lambda: build.calls_edges(held["units"]).groupBy("repo_id", "dst").agg(F.count("*").alias("n")))
    timed("importance", lambda: importance.importance(nodes, edges))
    timed("find", lambda: traverse.find(nodes, type="function", effect="db_write", name="ring"))
    seeds = nodes.where(F.col("id").isin("S1", "C5", "N3")).select(F.col("name").alias("seed"), "repo_id", "id")
    timed("impact", lambda: traverse.impact(seeds, edges))
    pairs = nodes.where(F.col("id") == "C5").select(F.lit("p").alias("pair"), "repo_id", F.col("id").alias("src"), F.lit("S1").alias("dst"))
    timed("flow", lambda: traverse.shortest_paths(pairs, edges, max_depth=6))
    timed("explain", lambda: traverse.explain(nodes, edges, nodes.where(F.col("type") == "class")))
    timed("snapshot_diff", lambda: refresh.diff_fingerprints(views.view(spark, sf, "snap_old"), views.view(spark, sf, "snap_new")))
    timed("domain_flows", lambda: reports.domain_flows(nodes, edges))
    timed("hubs", lambda: reports.hubs(nodes, edges))
    timed("chunks", lambda: export.node_chunks(nodes))
    timed("batches", lambda: batches.packed(batches.prioritized(batches.enrichable(build.nodes(held["units"])))))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "files": n_files, "edges": n_edges}))


if __name__ == "__main__":
    main()
