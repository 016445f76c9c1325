"""Candidate pairs of the fuzzy join against all pairs, and the choice among overlapping candidates against the walk."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import fuzzy
from skein.plans import text_queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


@pytest.mark.parametrize("least", [0.6, 0.8, 0.35, 0.0])
def test_no_pair_is_lost(spark, least):
    rng = random.Random(int(least * 100))
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(40)})
    spans = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(60)} | {n[:-1] + "é" for n in names})
    got = {(r.span, r.name) for r in fuzzy.near_pairs(spark.createDataFrame([(s,) for s in spans], "span string"), spark.createDataFrame([(n, n) for n in names] + [("", ""), (None, "x")], "name string, ord string"), least).collect()}
    want = {(s, n) for s in spans for n in names if distance(s, n) <= min(int(len(n) * (1 - least) + 1e-9), len(n) - 1)}
    assert want and want <= got


def test_few_rows_are_compared(spark):
    sf = "/root/testdata/sf0.01"
    texts, names = text_queries._ascii(spark, sf), text_queries._dictionary(spark, sf)
    spans = fuzzy.token_windows(texts, "doc_id", "text").select("span").distinct()
    pairs, by_length = fuzzy.near_pairs(spans, names, 0.8).count(), spans.select(F.length("span").alias("n")).join(names.select(F.length("name").alias("m")), F.expr("abs(n - m) <= floor(m * 0.2 + 1e-9)")).count()
    assert 0 < pairs < by_length / 20


def walk(rows):
    taken, out = set(), set()
    for start, stop, similarity in sorted(rows, key=lambda r: (-r[2], r[1] - r[0], r[0])):
        if taken.isdisjoint(range(start, stop)):
            taken |= set(range(start, stop))
            out.add((start, stop))
    return out


def test_rounds_equal_the_walk(spark):
    rng = random.Random(5)
    docs = {d: list({(a, b): (a, b, rng.choice([0.6, 0.7, 0.8, 0.9])) for a, b in ((a, a + rng.randint(1, 3)) for a in (rng.randint(0, 30) for _ in range(40)))}.values()) for d in range(30)}
    docs[99] = [(k, k + 2, 0.5 + k / 100) for k in range(40)]  # each one overlaps the next, which is better
    df = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows] + [(None, 0, 1, 0.9)], "doc_id long, start int, stop int, similarity double")
    got = {}
    for r in fuzzy.select_candidates(df).collect():
        got.setdefault(r.doc_id, set()).add((r.start, r.stop))
    assert got == {d: walk(rows) for d, rows in docs.items()}
    assert fuzzy.select_candidates(df.limit(0)).count() == 0


def test_nulls_and_empty_tables(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "aspirim now")], "doc_id long, text string")
    names = spark.createDataFrame([("aspirin", 1), (None, 2), ("aspirix", 3)], "name string, ord int")
    assert [(r.doc_id, r.name, r.similarity) for r in fuzzy.fuzzy_candidates(texts, names).collect()] == [(3, "aspirin", 0.857)]
    assert fuzzy.fuzzy_candidates(texts.limit(0), names).count() == 0 and fuzzy.fuzzy_candidates(texts, names.limit(0)).count() == 0
