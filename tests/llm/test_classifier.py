import re
import zlib

import numpy as np
import pytest

from skein.functions.shared import table
from skein.llm import classifier

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in classifier.op3_quality_score(spark, SF).collect()}


def test_held_out_accuracy(spark, scored):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    out = [(scored[d].score, q, scored[d].predicted) for d, q in labels.items() if scored[d].held_out]
    good, bad = [s for s, q, _ in out if q == 1], [s for s, q, _ in out if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([q == p for _, q, p in out]) > 0.93


def test_columns(scored):
    for d, r in scored.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_held_out_labels_and_other_columns_do_not_matter(spark, scored):
    labels = table(spark, SF, "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    docs = table(spark, SF, "documents").selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "0.5D AS score")
    again = {r.doc_id: r.score for r in classifier.score_quality(docs, turned).collect()}
    assert again == {d: r.score for d, r in scored.items()}


def test_word_vectors_against_a_plain_count(spark):
    texts = ["a b c a", "b c", "", None, "d"]
    got = classifier.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    index, tokens = classifier.index_vectors().astype(float), classifier.Tokens()
    want = np.zeros((classifier.ROWS, classifier.DIM))
    for t in texts:
        ids = tokens.rows(t)
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if 0 < abs(i - j) <= classifier.REACH:
                    want[a] += index[b]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.where(norm > 0, norm, 1), atol=1e-6)


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = classifier.Network().fit(x, y).predict(x)
    for lo in np.arange(0, 1, 0.2):
        inside = (p >= lo) & (p < lo + 0.2)
        assert abs(p[inside].mean() - y[inside].mean()) < 0.12


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, "a"), (None, ""), (3, "b " * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, 7)], "doc_id long, quality int")
    got = classifier.score_quality(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert classifier.score_quality(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.score for r in classifier.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_score_against_a_plain_network(spark):
    texts = {1: "a b c a. b!", 2: "C c C", 3: "", 4: None, 5: "one", 6: "a b " * 70_000}
    data = list(texts.items()) + [(i, "good words go here and there" if i % 2 else "x! y! z! x! y!") for i in range(10, 60)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 60)], "doc_id long, quality int")
    model = classifier.fit_quality(docs, labels)
    got = {r.doc_id: r.score for r in classifier.score_quality(docs, labels, model=model).collect()}
    net = model.network
    for doc_id, text in data:
        v = [model.vectors[zlib.crc32(t.encode()) % classifier.ROWS].astype(float) for t in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")]
        mean = sum(v) / len(v) if v else np.zeros(classifier.DIM)
        pairs = sum(a * b for a, b in zip(v, v[1:])) / (len(v) - 1) if len(v) > 1 else np.zeros(classifier.DIM)
        x = (np.concatenate([mean, pairs]) - net.mean) / net.scale
        z = net.b2 + sum(w * max(0.0, float(h)) for w, h in zip(net.w2, x @ net.w1 + net.b1))
        assert abs(got[doc_id] - 1 / (1 + np.exp(-np.clip(z / net.temperature, -30, 30)))) < 1e-5


def test_clashing_columns_give_way_and_repeated_ids_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {k % 3}", 5, "a", "b") for k in range(50)], "doc_id long, text string, score int, held_out string, predicted string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = classifier.score_quality(docs, labels)
    assert out.columns == ["doc_id", "text", "held_out", "score", "predicted"] and out.count() == 50
    seen = []
    monkeypatch.setattr(classifier.Network, "fit", lambda self, x, y: seen.append(len(y)) or self)
    classifier.fit_quality(docs, labels)
    assert seen == [int(zlib.crc32(b"1") % 5 != 0)]
