"""Findings of round 3, third pass."""

import random

from pyspark.sql import functions as F

from corpusgraph.operators import batches as bt


def test_prompts_are_cut_as_rows_stream(spark):
    rng = random.Random(8)
    rows = [("r", f"f{i:03d}.py", i // 7, f"{rng.randrange(9)}{i:03d}{j}", f"{i}-{j}", "x" * rng.randrange(1, 90)) for i in range(150) for j in range(rng.randrange(1, 5))]
    rows.append(("r", None, 3, "0", "nowhere", "x"))
    df = spark.createDataFrame(rows, "repo_id string, file_path string, batch long, priority string, id string, snippet string").repartition(5)
    cut = bt.prompts(df, max_chars=150)
    # one Python call per batch of rows, not one per group; snippets stay where they are
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
    want, first = {}, {}
    for _, path, _, priority, _, _ in rows[:-1]:
        first[path] = min(first.get(path, priority), priority)
    for batch in range(150 // 7 + 1):
        prompt = used = item = 0
        for _, _, _, _, id_, text in sorted((r for r in rows[:-1] if r[2] == batch), key=lambda r: (first[r[1]], r[3])):
            if used + len(text) > 150 and item > 0:
                prompt, used, item = prompt + 1, 0, 0
            want[id_] = (prompt, item)
            used, item = used + len(text), item + 1
    assert {r.id: (r.prompt, r.item) for r in cut.collect()} == want
    assert max(p for p, _ in want.values()) > 3
    one = bt.sized(df.where("batch = 0").withColumn("snippet", F.lit("y" * 400)))
    assert all(r.item == 0 for r in bt.cut(one, 150).collect())
