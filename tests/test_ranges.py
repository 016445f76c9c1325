"""Guarded states, ranks and previous values, against loops over each key."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import constants as K
from skein.operators import ranges, workflow
from skein.streaming import telemetry

STATUSES = sorted({x for pair in K.TRANSITIONS for x in pair})


def walk(rows):
    """Each key's events in turn: (key, ord) to (state before, accepted, state after)."""
    state, out = {}, {}
    for key, n, status in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        before = state.get(key)
        ok = (before, status) in K.TRANSITIONS or before is None and status == "DRAFT"
        state[key] = status if ok else before
        out[key, n] = (before, ok, state[key])
    return out


def likely(rng, n):
    """Keys, a hot one with most rows, whose events are mostly legal."""
    rows, state = [], {}
    for i in range(n):
        key = rng.choice([7] * 9 + [None, *range(5)])
        legal = [b for a, b in K.TRANSITIONS if a == state.get(key)] or ["DRAFT"]
        status = rng.choice(legal) if rng.random() < 0.6 else rng.choice([*STATUSES, None, "UNKNOWN"])
        if status in legal:
            state[key] = status
        rows.append((key, i, status))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_guarded_states_against_a_loop(spark, seed):
    rows = likely(random.Random(seed), 3000)
    df = spark.createDataFrame(rows, "user int, ord int, status string").withColumn("state", F.lit("input"))
    out = workflow.guard_events(df.repartition(3), "user", ["ord"], "status").collect()
    want = walk(rows)
    assert {(r.user, r.ord): (r.from_status, r.accepted, r.state) for r in out} == want and len(out) == len(rows)
    folded = {r.user: r for r in workflow.fold_status(workflow.guard_events(df, "user", ["ord"], "status"), "user", ["ord"]).collect()}
    for user in {r[0] for r in rows}:
        mine = [(n, *want[key, n]) for key, n in want if key == user]
        r = folded[user]
        assert (r.status, r.n_events, r.n_refused) == (max(mine)[3], len(mine), sum(not m[2] for m in mine))
        assert r.since == max((m[0] for m in mine if m[2]), default=None)


def test_a_hot_key_lies_in_several_ranges(spark):
    df = spark.createDataFrame([(7, i, "DRAFT") for i in range(4000)] + [(8, 0, "DRAFT")], "user int, ord int, status string")
    sizes = [r["count"] for r in ranges.in_ranges(df, "user", [F.col("ord")]).groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_a_refused_event_leaves_the_state(spark):
    rows = [("e", 1, "DRAFT"), ("e", 2, "SUBMITTED"), ("e", 3, "PUBLISHED"), ("e", 4, "PROCESSING"), ("f", 1, "SUBMITTED")]
    df = spark.createDataFrame(rows, "encounter string, ord int, status string")
    out = workflow.guard_events(df, "encounter", ["ord"], "status")
    assert [(r.ord, r.from_status, r.to_status) for r in workflow.refused(out, "status").orderBy("encounter").collect()] == [(3, "SUBMITTED", "PUBLISHED"), (1, None, "SUBMITTED")]
    assert {r.encounter: (r.status, r.n_refused) for r in workflow.fold_status(out, "encounter", ["ord"]).collect()} == {"e": ("PROCESSING", 1), "f": (None, 1)}
    assert workflow.guard_events(df.limit(0), "encounter", ["ord"], "status").count() == 0


def test_a_stream_refuses_alike(spark, tmp_path):
    schema = "encounter_id string, ord long, status string"
    rows = [(str(k), n, s) for k, n, s in likely(random.Random(3), 300)]
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = telemetry.illegal_transitions(stream).writeStream.format("memory").queryName("refused_events").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.encounter_id, r.ord): (r.from_status, r.to_status) for r in spark.table("refused_events").collect()}
    asked = {(k, n): s for k, n, s in rows}
    assert got == {at: (before, asked[at]) for at, (before, ok, _) in walk(rows).items() if not ok}


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_ranks_and_previous_values(spark, limit):
    rng = random.Random(4)
    rows = [(rng.choice([1] * 9 + [None, 2, 3]), i, rng.choice([None, 1, 2])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(3)
    place, before, want = {}, {}, {}
    for k, i, v in rows:
        place[k] = place.get(k, 0) + 1
        want[k, i] = (place[k], before.get(k))
        before[k] = v
    a = {(r.k, r.i): r.rank for r in ranges.ranked(df, "k", [F.col("i")], limit=limit).collect()}
    b = {(r.k, r.i): r.before for r in ranges.with_previous(df, "k", [F.col("i")], "v", "before", limit=limit).collect()}
    assert {at: (a[at], b[at]) for at in want} == want and len(a) == len(b) == len(rows)
    down = {(r.k, r.i): r.rank for r in ranges.ranked(df, "k", [F.col("i").desc()], limit=limit).collect()}
    assert all(down[k, i] == place[k] + 1 - n for (k, i), (n, _) in want.items())
    assert ranges.ranked(df.limit(0), "k", [F.col("i")], limit=limit).count() == 0
