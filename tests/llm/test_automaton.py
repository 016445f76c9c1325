import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import automaton as a


def plain(text, items):
    """n_words, n_hit, item ids: every window compared at every place."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    words, hit, ids = find(text), set(), set()
    for item_id, t in items:
        w = find(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[i : i + n]:
                    hit |= set(range(k, k + n))
                    ids.add(item_id)
    return len(words), len(hit), sorted(x for x in ids if x is not None)


token = st.sampled_from(["a", "b", "A", "é", "9"])
line = st.lists(token, max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(line, st.lists(st.lists(token, max_size=16).map(" ".join), max_size=4))
def test_scan_against_all_windows(text, items):
    items = [(str(i), t) for i, t in enumerate(items)]
    words, spans, ids = a.scan_text(text.encode(), a.Automaton([(i, t.encode()) for i, t in items]))
    assert (words, sum(s["stop"] - s["start"] for s in spans), ids) == plain(text, items)


LONG = " ".join(f"w{i}" for i in range(14))
ITEMS = [(1, LONG), (2, "Short One"), (3, None), (4, ""), (10, LONG), (None, "no id here"), (5, "..."), (5, "tail words only")]
TEXTS = [None, "", "w0 " + LONG + " x", LONG.upper() + "! short, ONE", "no id here", " ".join(f"w{i}" for i in range(9)), "tail words only " * 3, "é" * 10 + " short one" * 2, "x " * 20_000 + LONG]


@pytest.mark.parametrize("group_bytes", [a.GROUP_BYTES, 20])
def test_query_against_all_windows(spark, group_bytes):
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)] + [(None, "short one", "old"), (0, None, "old")], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = a.find_contamination(docs, bench, group_bytes=group_bytes).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        n, hit, ids = plain(r.text, [(None if i is None else str(i), t) for i, t in ITEMS])
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert a.find_contamination(docs.limit(0), bench).count() == 0
    assert a.find_contamination(docs, bench.limit(0)).first().n_hit == 0


def test_removal(spark):
    docs = spark.createDataFrame([(1, "Keep this. " + LONG + "; and that too, " + "more " * 20, 0), (2, LONG, 5), (3, "clean text", 10)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    got = {r.doc_id: r for r in a.decontaminate(docs, bench).collect()}
    assert set(got) == {1, 3} and got[1].text == "Keep this. ; and that too, " + "more " * 20
    assert got[1].n_chars == len(got[1].text) and got[3].text == "clean text"
    assert a.decontaminate(docs, bench).columns == docs.columns


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60).map(" ".join), st.lists(st.lists(st.sampled_from("aab"), min_size=1, max_size=30).map(" ".join), min_size=1, max_size=5))
def test_repeated_words_against_all_windows(text, items):
    items = [(str(i), t) for i, t in enumerate(items)]
    words, spans, ids = a.scan_text(text.encode(), a.Automaton([(i, t.encode()) for i, t in items]))
    assert (words, sum(s["stop"] - s["start"] for s in spans), ids) == plain(text, items)


def test_equal_words_take_linear_time():
    import time

    began = time.process_time()
    automaton = a.Automaton([("1", b"x " * 100_000), ("2", b"x x x"), ("3", b"x")])
    assert a.scan_text(b"x " * 100_000, automaton) == (100_000, [{"start": 0, "stop": 100_000}], ["1", "2", "3"])
    assert time.process_time() - began < 10


def test_a_worker_builds_a_group_once():
    one = a.kept_automaton("g1", [("1", b"a b")], 10)
    assert a.kept_automaton("g1", [], 10) is one and a.kept_automaton("g2", [], 10) is not one and list(a._KEPT) == ["g2"]
