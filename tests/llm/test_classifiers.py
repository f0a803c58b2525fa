"""Quality and toxicity: held-out accuracy on the given tables, defined results for odd rows."""

import os

import numpy as np
import pyarrow as pa
import pytest

from corpusgraph.llm import labelled, quality, queries, toxicity

SF = "/root/testdata/sf0.1"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


def held_out(spark, name, label, cut):
    out = queries.queries()[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    right = (out.predicted == out[label])
    ranks = out.score.rank()
    ones = (out[label] == 1).sum()
    auc = (ranks[out[label] == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(out) - ones))
    assert ((out.score >= cut).astype(int) == out.predicted).all() and out.score.between(0, 1).all()
    return right.mean(), auc


@given
def test_quality_held_out(spark):
    right, auc = held_out(spark, "op1_quality", "quality", 0.7)
    assert right > 0.98 and auc > 0.99


@given
def test_toxicity_held_out(spark):
    right, auc = held_out(spark, "op4_toxicity", "toxic", 0.5)
    assert right > 0.93 and auc > 0.87


@pytest.mark.parametrize("operator,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, odd, operator, label):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (5, 0), (99, 1), (None, 0), (8, None), (3, 7)], f"doc_id long, {label} int")
    model = operator.train(odd, labels)
    rows = operator.scored(odd, model).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == set(odd.columns)
    by_text = {}
    for r in rows:
        assert 0 <= r.score <= 1 and by_text.setdefault(r.text or "", r.score) == r.score
    nothing = operator.train(odd.limit(0), labels.limit(0))
    assert {r.score for r in operator.scored(odd, nothing).collect()} == {0.5}
    assert operator.scored(odd.limit(0), nothing).count() == 0


def test_score_is_the_sparse_dot_product():
    model = np.random.default_rng(0).standard_normal((1 << quality.BITS) + 1)
    texts = pa.array(["one two, two two", "", "a"])
    for text, got in zip(texts.to_pylist(), quality.score(texts, model)):
        index, count = quality.features(pa.array([text]))
        x = sum(model[i] for i in index) / max(count[0], 1) ** 0.5 + model[-1]
        assert abs(got - 1 / (1 + np.exp(-x))) < 1e-9


def test_misspellings_share_vectors():
    bad = pa.array([f"w{i} horribleword x{i}" for i in range(60)] + [f"w{i} pleasantly x{i}" for i in range(60)])
    model = toxicity.fit(bad, np.array([1] * 60 + [0] * 60))
    a, b = toxicity.score(pa.array(["w1 horriblewort x1", "w1 pleasandly x1"]), model)
    assert a > 0.5 > b


def test_bounded_sample_is_stable(spark, table):
    docs = table([(i, f"text {i}") for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    one = sorted(r.text for r in labelled.sample(docs, labels, "quality", 10).collect())
    assert len(one) == 10 and one == sorted(r.text for r in labelled.sample(docs.repartition(7), labels, "quality", 10).collect())


def test_toxicity_holds_subwords_of_few_texts_at_once(monkeypatch):
    held, features = [], toxicity.features

    def counted(texts):
        held.append(len(texts))
        return features(texts)

    monkeypatch.setattr(toxicity, "features", counted)
    texts = pa.array([f"word{i % 7} and more {'foul' if i % 2 else 'fair'}" for i in range(1000)])
    row, bias = toxicity.fit(texts, np.arange(1000) % 2)
    assert max(held) <= 64 and sum(held) == 1000
    assert toxicity.score(pa.array(["so foul", "so fair"]), [row, bias]).round().tolist() == [1.0, 0.0]
