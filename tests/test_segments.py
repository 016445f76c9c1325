"""Hand-computed cases of segment shaping and alignment."""

import random

from skein.operators import align, segments


def turns(spark, rows):
    return spark.createDataFrame([(1, i, s, a, b, t) for i, (s, a, b, t) in enumerate(rows)], "conv_id long, turn long, speaker_index long, start_ms long, end_ms long, text string")


def spans(df):
    return [(r.speaker_index, r.start_ms, r.end_ms) for r in df.orderBy("start_ms").collect()]


def test_merge_within_gap(spark):
    assert spans(segments.merge_turns(turns(spark, [(0, 0, 2000, ""), (0, 2300, 4000, "")]))) == [(0, 0, 4000)]


def test_gap_is_strict_and_speakers_stay_apart(spark):
    rows = [(0, 0, 2000, ""), (0, 2800, 3000, ""), (1, 3100, 4000, "")]
    assert spans(segments.merge_turns(turns(spark, rows))) == [(0, 0, 2000), (0, 2800, 3000), (1, 3100, 4000)]


def test_merge_equals_a_sequential_loop(spark):
    rng = random.Random(5)
    rows, at = [], 0
    for _ in range(200):
        at += rng.randrange(0, 1600)
        end = at + rng.randrange(0, 3000)
        rows.append((rng.randrange(2), at, end, ""))
        at = end
    want = []
    for s, a, b, _ in rows:
        if want and want[-1][0] == s and a - want[-1][2] < 800:
            want[-1] = (s, want[-1][1], b)
        else:
            want.append((s, a, b))
    assert spans(segments.merge_turns(turns(spark, rows))) == want


def test_split_long_turn(spark):
    got = spans(segments.split_turns(turns(spark, [(0, 0, 60_000, "")])))
    assert got == [(0, 0, 20_000), (0, 20_000, 40_000), (0, 40_000, 60_000)]


def test_merge_utterances_strips_dashes(spark):
    got = segments.merge_utterances(turns(spark, [(0, 0, 1, "- a "), (0, 2, 3, "　b"), (1, 4, 5, "c")])).orderBy("start_ms").collect()
    assert [r.text for r in got] == ["a b", "c"]


def test_best_overlap_and_nearest(spark):
    t = turns(spark, [(0, 0, 5000, ""), (1, 5000, 10_000, ""), (0, 40_000, 41_000, "")])
    s = spark.createDataFrame([(1, 0, 4000, 8000), (1, 1, 20_000, 22_000), (1, 2, 2500, 7500), (1, 3, 25_000, 26_000)], "conv_id long, seg long, start_ms long, end_ms long")
    got = {r.seg: (r.turn, r.overlap_ms) for r in align.best_overlap(s, t).collect()}
    assert got == {0: (1, 3000), 1: (1, 0), 2: (0, 2500), 3: (2, 0)}


def test_nearest_tie_takes_the_first_turn(spark):
    t = turns(spark, [(0, 0, 2000, ""), (1, 20_000, 22_000, "")])
    s = spark.createDataFrame([(1, 0, 10_000, 12_000)], "conv_id long, seg long, start_ms long, end_ms long")
    assert [r.turn for r in align.best_overlap(s, t).collect()] == [0]


def test_overlap_pairs_across_bins_come_once(spark):
    a = turns(spark, [(0, 0, 200_000, "x")])
    assert align.overlapping(a, a).count() == 1


def test_every_hypothesis_segment_is_aligned(spark):
    from skein.plans.registry import QUERIES
    from skein.sources.tables import timed_segments

    sf = "/root/testdata/sf0.001"
    got = {(r.conv_id, r.seg) for r in QUERIES["best_overlap_align_all"](spark, sf).collect()}
    assert got == {(r.conv_id, r.turn) for r in timed_segments(spark, sf).collect()}
