import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skein.functions.shared import table
from skein.llm import quality_rules as rules

SF = "/root/testdata/sf0.01"


def plain(text):
    """The base counts by their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 2000 else len(lines) - len(set(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in rules.op13_quality_rules(spark, SF).collect()}


def test_base_counts_against_their_definitions(spark, rows):
    for d in table(spark, SF, "documents").select("doc_id", "text").collect():
        r = rows[d.doc_id]
        want = plain(d.text)
        assert tuple(r[1:6]) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.probability >= rules.THRESHOLD)


def test_held_out_documents(spark, rows):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    good, bad = [rows[d] for d, q in labels.items() if q == 1], [rows[d] for d, q in labels.items() if q == 0]
    assert len(good) > 20 and len(bad) > 5  # few, so bounds are wide
    assert np.mean([g.probability > b.probability for g in good for b in bad]) > 0.95
    passed = [g for g in good if not g.base_failed]
    assert np.mean([g.kept for g in passed]) > 0.95 and sum(b.kept for b in bad) <= 1


def test_learnt_from_texts_and_four_fifths_of_the_labels_alone(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = rules.fit_rules(docs, labels), rules.fit_rules(docs.selectExpr("doc_id", "text", "'x' AS lang"), turned)
    assert np.array_equal(a.weights, b.weights) and a.intercept == b.intercept


def test_calibration():
    rng = np.random.default_rng(0)
    margin = rng.normal(0, 3, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * margin - 1)))).astype(float)
    a, b = rules.platt(margin, y)
    assert abs(a - 0.5) < 0.05 and abs(b + 1) < 0.08


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = "".join(np.random.default_rng(1).choice(list("ab cdé \U0001f600"), 5000))
    whole = rules.features(*rules._words(text))
    monkeypatch.setattr(rules, "_PART", 64)
    assert np.array_equal(whole, rules.features(*rules._words(text)))


def test_many_different_words(monkeypatch):
    words = [b"%d" % i for i in np.random.default_rng(2).integers(0, 30, 3000)]
    want = plain(" ".join(w.decode() for w in words))[4]
    assert rules.repeated_words(words) == want
    assert rules.repeated_words([b"a"] * 5) == 5 and rules.repeated_words([b"a"] * 3) == 0


def test_edge_rows(spark):
    model = rules.train(np.zeros((0, rules.WORD_PLACES + rules.CHAR_PLACES)), np.zeros(0))
    long = "word " * 100_000
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, long, "x"), (None, long, "x"), (3, "a b c\x1cd", "x")], "doc_id long, text string, kept string")
    out = rules.apply_rules(docs, model)
    assert out.columns == ["doc_id", "text", *rules._COUNTS, "probability", "base_failed", "kept"]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_repeat_words, r.base_failed, r.kept) for r in out.collect()}
    assert got == {(1, 0, 0, 0, True, False), (2, 0, 0, 0, True, False), (None, 100_000, 400_000, 100_000, True, False), (3, 1, 7, 0, True, False)}
    assert out.count() == 5 and rules.apply_rules(docs.limit(0), model).count() == 0
    assert {r.probability for r in out.collect()} == {0.5}
