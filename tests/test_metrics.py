"""Hand-computed cases of the metrics, and the sweep against a literal frame grid."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import diarization, edit, enrollment


@pytest.mark.parametrize("a,b,want", [("abc", "xbz", (2, 0, 0)), ("abcd", "abd", (0, 1, 0)), ("abc", "abcd", (0, 0, 1)), ("", "", (0, 0, 0)), ("", "ab", (0, 0, 2))])
def test_operations(a, b, want):
    assert edit.operation_counts(a, b) == want


def test_rates(spark):
    rows = spark.createDataFrame([("a b c", "a x c"), ("", ""), ("", "a b"), ("a b c d", "b c d")], "r string, h string")
    got = [(r.substitutions, r.deletions, r.insertions, r.rate) for r in edit.with_operations(rows, "r", "h").collect()]
    assert got == [(1, 0, 0, 1 / 3), (0, 0, 0, 0.0), (0, 0, 2, math.inf), (0, 1, 0, 0.25)]


def test_micro_average(spark):
    df = spark.createDataFrame([("x", 1, 2), ("x", 0, 98)], "k string, errors long, length long")
    assert edit.micro_average(df, ["k"]).first().rate == 0.01


def side(spark, rows):
    return spark.createDataFrame([(1, s, r, a, b) for s, r, a, b in rows], "conv_id long, speaker string, role string, start_ms long, end_ms long")


def der(spark, ref, hyp, collar=0):
    r = [(s, s, a, b) for s, a, b in ref]
    return diarization.error_rate(side(spark, r), side(spark, [(s, None, a, b) for s, a, b in hyp]).drop("role"), collar).first()


REF = [("A", 0, 10_000), ("B", 10_000, 20_000)]


def test_swapped_names(spark):
    r = der(spark, REF, [("1", 0, 10_000), ("0", 10_000, 20_000)])
    assert (r.der, r.role_purity) == (0, 1)


def test_missed(spark):
    r = der(spark, REF, [("0", 0, 10_000), ("1", 10_000, 15_000)])
    assert (r.missed, r.der) == (5, 0.25)


def test_false_alarm(spark):
    r = der(spark, REF, [("0", 0, 10_000), ("1", 10_000, 24_000)])
    assert (r.false_alarm, r.der) == (4, 0.2)


def test_confusion(spark):
    r = der(spark, [*REF, ("A", 20_000, 30_000)], [("0", 0, 10_000), ("1", 10_000, 30_000)])
    assert (r.confusion, round(r.der, 9), round(r.role_purity, 9)) == (10, round(1 / 3, 9), round(2 / 3, 9))


def test_split_speaker(spark):
    r = der(spark, [("A", 0, 20_000)], [("0", 0, 10_000), ("1", 10_000, 20_000)])
    assert (r.der, r.role_purity) == (0.5, 1)


def test_collar(spark):
    hyp = [("0", 0, 10_200), ("1", 10_200, 20_000)]
    assert der(spark, REF, hyp).confusion == 0.2
    assert der(spark, REF, hyp, 250).der == 0


def test_overlap_recall(spark):
    ref = [("A", 0, 10_000), ("B", 5_000, 10_000)]
    assert der(spark, ref, [("0", 0, 10_000), ("1", 5_000, 10_000)]).overlap_recall == 1
    assert der(spark, ref, [("0", 0, 10_000)]).overlap_recall == 0
    assert der(spark, REF, [("0", 0, 10_000)]).overlap_recall is None


def test_empty_hypothesis(spark):
    r = der(spark, REF, [])
    assert (r.der, r.hyp_speakers) == (1, 0)


def grid(ref, hyp, collar):
    end = max(b for _, _, b in [*ref, *hyp])
    scored = missed = alarm = 0
    for i in range(round(end / 10)):
        t = i * 10 + 5
        if collar and any(abs(t - x) < collar for _, a, b in ref for x in (a, b)):
            continue
        nr, nh = len({s for s, a, b in ref if a <= t < b}), len({s for s, a, b in hyp if a <= t < b})
        scored, missed, alarm = scored + nr, missed + max(0, nr - nh), alarm + max(0, nh - nr)
    return scored, missed, alarm


@pytest.mark.parametrize("collar", [0, 137, 250])
def test_sweep_equals_frame_grid(spark, collar):
    rng = random.Random(collar)
    for _ in range(3):
        line = lambda: [(rng.choice("AB"), a := rng.randrange(3000), a + rng.randrange(1, 900)) for _ in range(6)]
        ref, hyp = line(), line()
        r = der(spark, ref, hyp, collar)
        assert tuple(round(x * 100) for x in (r.scored, r.missed, r.false_alarm)) == grid(ref, hyp, collar)


def test_cluster_labels(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 50.0), ("b", [0.0, 1.0], 45.0), ("c", [0.0, 1.0], 5.0)], "cluster string, embedding array<double>, seconds double")
    vp = spark.createDataFrame([([1.0, 0.0],)], "voiceprint array<double>")
    got = {r.cluster: (r.label, round(r.share, 6)) for r in enrollment.label_clusters(df, vp).collect()}
    assert got == {"a": ("doctor", 0.5), "b": ("other", 0.45), "c": ("contamination", 0.05)}


def test_turn_labels(spark):
    d = spark.createDataFrame([("a", "doctor"), ("b", "other"), ("c", "contamination")], "cluster string, label string")
    t = spark.createDataFrame([(0, "a", 0.85), (1, "a", 0.25), (2, "a", None), (3, "c", 0.20), (4, "b", 0.70)], "i int, cluster string, similarity double")
    assert [r.label for r in enrollment.label_turns(t, d).orderBy("i").collect()] == ["doctor", "other", "doctor", "contamination", "doctor"]


def test_score_with_swapped_labels(spark):
    ref = side(spark, [("A", "doctor", 0, 10_000), ("B", "patient", 10_000, 20_000), ("C", "contamination", 20_000, 30_000)])
    hyp = side(spark, [("0", None, 0, 10_000), ("1", None, 10_000, 20_000), ("2", None, 20_000, 30_000)]).drop("role")
    d = spark.createDataFrame([(1, "0", "doctor"), (1, "1", "contamination"), (1, "2", "other")], "conv_id long, speaker string, label string")
    r = enrollment.score(ref, hyp, d, collar_ms=0).first()
    assert (r.contamination_kept, r.conversation_dropped, r.doctor_recall, r.doctor_precision) == (1.0, 0.5, 1.0, 1.0)


def test_margin(spark):
    d = spark.createDataFrame([(1, "0", 0.8), (1, "1", 0.3), (1, "2", 0.1)], "conv_id long, speaker string, similarity double")
    roles = spark.createDataFrame([(1, "0", "doctor"), (1, "1", "patient"), (1, "2", "contamination")], "conv_id long, speaker string, role string")
    assert round(enrollment.similarity_margin(d, roles).first().margin, 9) == 0.5


def test_zero_vector_stays(spark):
    assert spark.range(1).select(enrollment.normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("v")).first().v == [0.0, 0.0]
