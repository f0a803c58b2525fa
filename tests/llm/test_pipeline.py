"""The stages of the pipeline: columns, decisions against brute force, odd rows; the queries against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusgraph.llm import queries, settings
from .conftest import prose

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_stages_keep_rows_and_columns(spark, odd, tmp_path):
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(6, 80))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, counts = odd, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == odd.columns
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == odd.columns
        docs = corpus_pipeline.written(out, "test")
        counts.append(docs.count())
    # one label only: everything looks like it or not; then copies go, then the leak
    assert counts[0] in (0, odd.count())
    docs = stage_of("minhash")(spark, odd, str(tmp_path))
    assert docs.count() == 9 and stage_of("decontamination")(spark, docs, str(tmp_path)).where(F.col("text") == prose(6, 80)).count() == 0
    assert stage_of("records")(spark, odd.limit(0), str(tmp_path)).count() == 0
    assert stage_of("records")(spark, odd, str(tmp_path)).count() == odd.count()


def stage_of(name):
    return dict(corpus_pipeline.STAGES)[name]


@given
def test_run_equals_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in queries.queries()["op4_toxicity"](spark, SF).collect() if r.predicted}
    left = stage_of("toxicity")(spark, docs, SF)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - toxic
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(got) < docs.count() and not toxic & {r.doc_id for r in got}
    start = 0
    for r in sorted(got, key=lambda r: r.doc_id):
        assert r.start == start
        start += r.n_tokens


@given
@pytest.mark.parametrize("name", sorted(queries.twins()))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    rel = con.execute(queries.twins()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    rows = lambda it: sorted((tuple(r[c] for c in sorted(names)) for r in it), key=repr)
    assert rows(got.collect()) == rows(dict(zip(names, r)) for r in rel.fetchall())


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")} == set(range(1, 14)) and "pipeline" in queries.queries()
    assert abs(sum(settings.MIX["source"].values()) - 1) < 1e-9
