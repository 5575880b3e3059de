import random

import numpy as np
import pytest

from maskwright.llm import toxicity

DOCS = "doc_id long, text string, score string"


def test_coordinates_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(random.Random(3).choices("You are the worst , word and Another".split(), k=40))
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "_PIECE", 7)
    monkeypatch.setattr(toxicity, "_MEMO_WORDS", 3)
    assert np.array_equal(toxicity.features(text), whole)
    assert len(toxicity.features(None)) == len(toxicity.features(" .. ")) == 0


def test_ftrl_step_by_step():
    """One coordinate and the intercept against the published update, by hand."""
    m = toxicity.Ftrl(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z = n = bz = bn = w = b = 0.0
    for label in (1, 1, 0, 1, 0, 1):
        at = np.array([3])
        g = 1 / (1 + np.exp(-(w + b))) - label
        m.learn(at, label)
        for _ in (0,):
            s = (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5
            z, n = z + g - s * w, n + g * g
            s = (np.sqrt(bn + g * g) - np.sqrt(bn)) / 0.5
            bz, bn = bz + g - s * b, bn + g * g
        w = 0.0 if abs(z) <= 0.1 else -(z - np.sign(z) * 0.1) / ((1 + np.sqrt(n)) / 0.5 + 0.2)
        b = -bz / ((1 + np.sqrt(bn)) / 0.5)
        assert m.weights(at)[0] == pytest.approx(w) and m.bias() == pytest.approx(b)


def test_held_out_accuracy_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model.places, again.places) and model.bias == again.bias
    assert 0 < len(model.places) < 20_000
    test = labels.where("crc32(cast(doc_id as string)) % 4 = 2").join(docs, "doc_id")
    told = toxicity.score(test, model).selectExpr("toxic", "int(score >= 0.3) p").groupBy("toxic").avg("p").collect()
    rate = {r.toxic: r[1] for r in told}
    assert rate[1] > 0.85 and rate[0] < 0.01


def test_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    rows = [(1, "bad bad words", "x"), (3, "good words", "x"), (None, "bad", "x"), (4, None, "x"), (5, "", "x"), (5, "", "x"), (6, "bad " * 50_000, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = toxicity.score(docs, toxicity.train(docs.select("doc_id", "text"), labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    none = toxicity.train(docs.select("doc_id", "text").limit(0), labels.limit(0))
    assert toxicity.score(docs, none).select("score").distinct().count() == 1
    assert toxicity.score(docs.limit(0), none).count() == 0
