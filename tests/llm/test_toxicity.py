"""Toxicity by held-out accuracy, and the learner against its update rule."""

import math
import random

import numpy as np
import pytest

from sparkloom.llm import toxicity


def test_learner_follows_the_update_rule():
    random.seed(1)
    bits, z, n = 4, [0.0] * 17, [0.0] * 17

    def weight(i):
        shrunk = 0.0 if i < 16 and abs(z[i]) <= toxicity.L1 else z[i] - (math.copysign(toxicity.L1, z[i]) if i < 16 else 0)
        return -shrunk / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    learner = toxicity.Learner(bits)
    for _ in range(300):
        at, label = sorted(random.sample(range(16), random.randint(0, 6))), random.random() < 0.5
        w = {i: weight(i) for i in [*at, 16]}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in w:
            step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
            z[i], n[i] = z[i] + g - step * w[i], n[i] + g * g
        learner.learn(np.array(at, np.int64), int(label))
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)
    again = toxicity.Learner(bits, learner.state())
    assert np.array_equal(again.z, learner.z) and np.array_equal(again.weights(slice(0, 16)), learner.weights(slice(0, 16)))


def test_features_of_long_texts_are_whole(monkeypatch):
    text = " ".join(f"w{i % 50} thing{i % 7}" for i in range(400))
    want = toxicity.Features(20).distinct(text)
    monkeypatch.setattr(toxicity, "STEP", 37)
    monkeypatch.setattr(toxicity, "KNOWN", 5)
    assert np.array_equal(toxicity.Features(20).distinct(text), want)
    assert len(toxicity.Features(20).distinct("")) == 0 and len(toxicity.Features(20).distinct("One")) == 1


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return {r.doc_id: r for r in toxicity.op13_toxicity(spark, sf).collect()}, {r.doc_id: r.toxic for r in labels.collect()}


def test_held_out_documents(scored):
    import zlib

    got, marked = scored
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    apart = [(r.score, marked[d]) for d, r in got.items() if r.held_out and d in marked]
    bad, good = ([s for s, y in apart if y == v] for v in (1, 0))
    better = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert len(apart) > 50 and better > 0.85
    assert sum(s >= 0.5 for s in good) <= 0.02 * len(good)


def test_weights_are_few_and_labels_are_no_input(spark):
    docs = spark.createDataFrame([(i, f"plain words {i % 13} of text {'you utter moron' if i % 3 == 0 else 'you kind friend'}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 300, 2)], "doc_id long, toxic int")
    at, w, bias = toxicity.fit(docs, labels)
    assert 0 < len(at) < 40
    asked = spark.createDataFrame([(1, "a moron"), (1, "a friend"), (None, "a moron")], "doc_id long, text string")
    one, two, three = (r.score for r in sorted(toxicity.score(asked, (at, w, bias)).collect(), key=lambda r: (r.doc_id is None, -r.score)))
    assert one == three > two
    few = toxicity.fit(docs, labels, rows=10)
    assert len(few[0]) <= len(at)


def test_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, "a"), (0, 0, "b"), (1, 0, "c"), (None, 1, "d"), (4, None, "e"), (99, 1, "f")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert all(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(no_docs, labels).collect() == []
