import re
from decimal import Decimal

import pytest

from skein.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight, cut at the cap, the excess dealt out again until none is above."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed, free = float(sum(sizes.values())), {}, list(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = float(cap * sizes[s])
            left -= fixed[s]
            free.remove(s)
    return fixed


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def many():
    out = []
    for i in range(600):
        source = None if i % 50 == 7 else f"s{(i * i) % 7}" if i % 3 else "hot"
        out.append((i, " ".join(["word"] * (i % 23 + 1)) if i % 31 else None, source))
    return [*out, (9001, "x " * 4000, "s1"), (9002, "tiny", "lone"), (9003, "", "void")]


def test_targets_against_resharing(spark):
    data = many()
    got = mixing.mix(rows(spark, data)).collect()
    sizes = {}
    for _, text, source in data:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    assert len(got) == len(data)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    for source in sizes:
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - want[source]) <= max(r.size for r in mine) / 2 + 1
        floors = {r.copies for r in mine}
        assert max(floors) - min(floors) <= 1  # whole epochs come first


def test_bins_agree_with_one_sort(spark, monkeypatch):
    data = many()
    whole = {r.doc_id: r.taken for r in mixing.mix(rows(spark, data)).collect()}
    monkeypatch.setattr(mixing, "SORT_ROWS", 2)
    monkeypatch.setattr(mixing, "BINS", 4)
    assert {r.doc_id: r.taken for r in mixing.mix(rows(spark, data)).collect()} == whole


def test_quality_raises_the_chance(spark):
    data = [(i, ("good words here " if i % 2 else "@@@ ### !!!"), "a") for i in range(400)] + [(1000 + i, "some other words", "b") for i in range(1600)]
    got = mixing.mix(rows(spark, data), weights=(1, 9)).where("source = 'a' AND copies > 0").collect()
    good = sum(r.doc_id % 2 for r in got)
    assert good > len(got) - good


def test_equal_rows_share_a_decision_and_reruns_agree(spark):
    data = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "d e", "x"), (None, "f", "x"), (None, None, None)] * 3
    df = rows(spark, data)
    one, two = (sorted(map(str, mixing.mix(df).collect())) for _ in range(2))
    assert one == two and len(one) == 15


def test_empty_and_clashing_columns(spark):
    assert mixing.mix(rows(spark, [])).count() == 0
    out = mixing.mix(spark.createDataFrame([(1, "a", "s", Decimal(5), "keep")], "doc_id long, text string, source string, size decimal(3,0), extra string"))
    assert out.first().size == 1 and out.first().extra == "keep"


def test_documents_without_words_are_taken_as_often_as_others_at_most(spark):
    data = [(i, "", "small") for i in range(60)] + [(100, "a b", "small"), (101, "c d", "small")] + [(200 + i, "w " * 50, "large") for i in range(40)]
    got = mixing.mix(rows(spark, data), weights=(1, 5)).collect()
    assert max(r.copies for r in got) <= 3
    got = mixing.mix(rows(spark, data), weights=(5, 1)).collect()
    assert {r.copies for r in got if r.source == "small" and r.size} == {3} and max(r.copies for r in got) == 3
