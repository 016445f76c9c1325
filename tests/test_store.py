"""Appended rows, guards and listings on small inputs; counts and assignments against brute force."""

import functools
import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.operators import store, telemetry
from skein.operators.diarization import falling_pairs, heaviest_pairs
from skein.operators.edit import operation_counts


def test_listings_with_a_filter(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "a", 4), (4, None, 5)], "id int, e string, t int")
    assert [r.id for r in store.children(df, "e", "t", "id", "a").collect()] == [3, 1]
    assert [r.id for r in store.stage_runs(df, "t", "id", "e", "a").collect()] == [1, 3]
    assert [r.id for r in store.stage_runs(df, "t", "id", "e").collect()] == [2, 1, 4, 3]


def test_append_without_rows_writes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id int")
    path = str(tmp_path / "log")
    assert not store.append(df.where("false"), path) and not (tmp_path / "log").exists()
    assert store.append(df, path) and store.append(df, path) and spark.read.parquet(path).count() == 2


def test_first_version_only_from_a_draft(spark):
    enc = spark.createDataFrame([(1, "DRAFT", None, None), (2, "APPROVED", "x", None), (3, "DRAFT", None, None)], "encounter_id int, status string, draft_version_id string, updated_at string")
    inputs = spark.createDataFrame([(1, "b", None, "t"), (1, "a", "text", "t"), (2, "c", "", "t"), (9, "d", "", "t")], "encounter_id int, version_id string, transcript_text string, created_at string")
    versions, after, audit, rejected = store.first_versions(enc, inputs)
    assert [(r.version_id, r.version_number, r.status) for r in versions.collect()] == [("a", 1, "draft")]
    assert sorted((r.encounter_id, r.status, r.draft_version_id) for r in after.collect()) == [(1, "SUBMITTED", "a"), (2, "APPROVED", "x"), (3, "DRAFT", None)]
    assert audit.collect()[0].detail == '{"version_id":"a","transcript_len":4}'
    assert sorted(r.version_id for r in rejected.collect()) == ["b", "c", "d"]


def test_runs_without_segments_and_unknown_completions(spark):
    asked = spark.createDataFrame([(1, "t"), (2, "t")], "run_id int, created_at string")
    segments = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "run_id int, turn int, text string")
    runs = store.new_runs(asked, segments, "turn")
    assert {r.run_id: r.segments_json for r in runs.collect()} == {1: '[{"turn":1,"text":"a"},{"turn":2,"text":"b"}]', 2: "[]"}
    after, unknown = store.complete_runs(runs, spark.createDataFrame([(2, "u"), (2, "w"), (7, "w")], "run_id int, completed_at string"))
    assert {r.run_id: (r.status, r.updated_at) for r in after.collect()} == {1: ("needs_role_confirmation", "t"), 2: ("completed", "w")}
    assert [r.run_id for r in unknown.collect()] == [7]


def test_guard_wants_an_original_of_that_encounter(spark):
    assets = spark.createDataFrame([("a", 1, "original"), ("b", 1, "derived")], "asset_id string, encounter_id int, kind string")
    good, bad = store.owned(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), (None, 1)], "asset_id string, encounter_id int"), assets)
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and bad.count() == 4


def test_report_keeps_long_names_and_dashes(spark):
    df = spark.createDataFrame([("ab", 1.25), ("abcdef", None), (None, 1234.5)], "s string, x double")
    assert sorted(r.line for r in store.report_lines(df, [("s", 4), ("x", 7)]).collect()) == sorted(["ab      1.3", "abcdef      -", "-    1234.5"])


def _counts(a, b):
    @functools.cache
    def best(i, j):
        ways = []
        if i and j:
            e, s, d, n = best(i - 1, j - 1)
            ways.append((e + (a[i - 1] != b[j - 1]), 0, s + (a[i - 1] != b[j - 1]), d, n))
        if i:
            e, s, d, n = best(i - 1, j)
            ways.append((e + 1, 1, s, d + 1, n))
        if j:
            e, s, d, n = best(i, j - 1)
            ways.append((e + 1, 2, s, d, n + 1))
        e, _, *rest = min(ways, key=lambda w: w[:2]) if ways else (0, 0, 0, 0, 0)
        return (e, *rest)

    return best(len(a), len(b))[1:]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_operation_counts_are_the_recursive_ones(a, b):
    assert operation_counts(a, b) == _counts(a, b)


def test_operation_counts_of_long_texts():
    words = [f"w{i % 977}" for i in range(6_000)]
    assert operation_counts(words, words[3:] + ["new"]) == (0, 3, 1)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4), st.integers(1, 5), st.data())
def test_heaviest_pairs_are_the_best_of_all(n, m, data):
    w = np.array(data.draw(st.lists(st.lists(st.integers(0, 6), min_size=m, max_size=m), min_size=n, max_size=n)))
    pairs = heaviest_pairs(w)
    assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
    k = min(n, m)
    best = max(sum(w[r, c] for r, c in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    assert sum(w[r, c] for r, c in pairs) == best


def test_falling_pairs_need_not_be_the_best():
    assert falling_pairs(np.array([[5, 4], [4, 0]])) == [(0, 0)]
    assert sorted(heaviest_pairs(np.array([[5, 4], [4, 0]]))) == [(0, 1), (1, 0)]


def test_exact_median_with_ties_nulls_and_far_values(spark):
    groups = {"one": [3.0], "two": [1.0, 4.0], "ties": [2.0] * 5 + [9.0] * 4, "far": [0.0, 0.1, 0.2, 1e12], "even": [5.0, 5.0, 5.0, 5.0], "spread": [float(i * i % 101) for i in range(100)]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("one", None), (None, 1.0)]
    got = telemetry.exact_median(spark.createDataFrame(rows, "stage string, ms double"), "stage", "ms", bins=8)
    assert {r.stage: r["median"] for r in got.collect()} == {k: float(np.median(v)) for k, v in groups.items()}


def test_requests_for_assets_are_read_once(spark):
    from skein.plans import registry

    plan = registry.QUERIES["owned_assets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3 and plan.count("Join ") == 2
    assets = spark.createDataFrame([("a", 1, "original"), ("a", 1, "original"), ("b", 1, "derived")], "asset_id string, encounter_id int, kind string")
    asked = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), (None, 1), ("a", None)], "asset_id string, encounter_id int")
    got = sorted((str(r.asset_id), str(r.encounter_id), r.granted) for r in store.with_grants(asked, assets).collect())
    assert got == [("None", "1", False), ("a", "1", True), ("a", "1", True), ("a", "2", False), ("a", "None", False), ("b", "1", False)]


def test_overlap_matrix():
    import pandas as pd

    from skein.operators.diarization import overlap_matrix

    group = pd.DataFrame({"ref": ["b", "a", "b", "b"], "hyp": ["y", "x", "y", "x"], "frames": [3, 4, 5, 1]})
    refs, hyps, weights = overlap_matrix(group)
    assert (list(refs), list(hyps), weights.tolist()) == (["a", "b"], ["x", "y"], [[4, 0], [1, 8]])
