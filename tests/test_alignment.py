"""Alignment counts against the full matrix, and impostors against all pairs."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import edit, enrollment


def plain_counts(a, b):
    """The walk back through the full matrix: match, substitution, deletion, insertion."""
    e = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            e[i][j] = min(e[i - 1][j - 1] + (x != y), e[i - 1][j] + 1, e[i][j - 1] + 1)
    i, j, s, d, n = len(a), len(b), 0, 0, 0
    while i or j:
        if i and j and e[i][j] == e[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            s += a[i - 1] != b[j - 1]
            i, j = i - 1, j - 1
        elif i and e[i][j] == e[i - 1][j] + 1:
            i, d = i - 1, d + 1
        else:
            j, n = j - 1, n + 1
    return s, d, n


def test_counts_of_many_pairs_against_the_matrix():
    rng = random.Random(1)
    pairs = [((), ()), ((), "ab"), ("ab", ()), ("a" * 70, "b"), ("b", "a" * 70)]
    for _ in range(500):
        a = [rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(0, 40))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 60))] if rng.random() < 0.4 else list(a)
        for _ in range(rng.randint(0, 9)):
            k = rng.randint(0, len(b))
            b[k : k + 1] = rng.choice([[], [rng.randint(0, 3)], b[k : k + 1] + [rng.randint(0, 3)]])
        pairs.append((a, b))
    assert edit.all_operation_counts(pairs) == [plain_counts(a, b) for a, b in pairs]
    assert [edit.operation_counts(a, b) for a, b in pairs[:50]] == [plain_counts(a, b) for a, b in pairs[:50]]


def test_long_texts_with_few_errors_are_quick():
    rng = random.Random(2)
    a = [rng.randint(0, 3000) for _ in range(20_000)]
    b = list(a)
    for _ in range(200):
        k = rng.randrange(len(b))
        b[k : k + 1] = rng.choice([[], [-1], [b[k], -2]])
    began = time.process_time()
    s, d, n = edit.operation_counts(a, b)
    assert s + d + n <= 200 and d - n == len(a) - len(b)
    assert time.process_time() - began < 4  # the whole matrix would take minutes here


@pytest.mark.parametrize("n_doctors,spread", [(1, 1), (2, 1), (40, 1), (300, 0.2)])
def test_impostors_against_all_pairs(spark, n_doctors, spread):
    rng = np.random.default_rng(n_doctors)
    centres = rng.normal(size=(5, 6))
    prints = [(str(d), (centres[d % 5] + spread * rng.normal(size=6)).tolist()) for d in range(n_doctors)] + [("zero", [0.0] * 6), (None, [1.0] * 6), ("none", None)]
    clusters = [(k, str(rng.integers(0, n_doctors)), (centres[k % 5] + spread * rng.normal(size=6)).tolist()) for k in range(60)] + [(97, "1", None), (98, None, [1.0] * 6), (99, "1", [0.0] * 6)]
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {}
    for k, doctor, v in clusters:
        near = [float(unit(v) @ unit(p)) for d, p in prints[:n_doctors] if d != doctor] if v and any(v) and doctor else []
        want[k] = max(near, default=None)
    c = spark.createDataFrame(clusters, "cluster long, doctor string, embedding array<double>")
    v = spark.createDataFrame(prints, "doctor string, voiceprint array<double>")
    out = enrollment.impostors(c, v, "cluster")
    got = {r.cluster: r.impostor for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] is None if w is None else math.isclose(got[k], w, abs_tol=1e-12) for k, w in want.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert enrollment.impostors(c, v.limit(0), "cluster").where("impostor IS NOT NULL").count() == 0 and enrollment.impostors(c.limit(0), v, "cluster").count() == 0


def test_vectors_of_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="different lengths"):
        df.select(enrollment.cosine(F.col("a"), F.col("b"))).collect()
    nulls = spark.createDataFrame([(None, [1.0])], "a array<double>, b array<double>")
    assert nulls.select(enrollment.dot(F.col("a"), F.col("b")).alias("x")).first().x is None
