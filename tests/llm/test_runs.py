import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from skein.functions.shared import table
from skein.llm import runs

SF = "/root/testdata/sf0.001"


def plain_runs(words, least_words=24, exponent=3):
    """Every run, period by period, with comparisons alone."""
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least_words, exponent * q) and not any(all(words[k] == words[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, q, size))
            i = max(j, i + 1)
    return sorted(out)


def plain_lyndon(codes):
    return [max(j - i for j in range(i + 1, len(codes) + 1) if all(codes[i:j] < codes[k:j] for k in range(i + 1, j))) for i in range(len(codes))]


def test_lyndon_words_against_their_definition():
    rng = random.Random(1)
    for _ in range(600):
        known = {}
        codes = [known.setdefault(rng.randint(0, 2), len(known)) for _ in range(rng.randint(0, 14))]
        length, group = runs.lyndon_words(codes)
        assert length == plain_lyndon(codes)
        for i, a in enumerate(length):
            assert all((group[i] == group[j]) == (codes[i : i + a] == codes[j : j + b]) for j, b in enumerate(length))


def test_runs_against_every_period():
    rng = random.Random(2)
    for _ in range(600):
        words, n = [], rng.randint(0, 120)
        while len(words) < n:
            words += [b"%d" % rng.randint(0, 3) for _ in range(rng.randint(1, 9))] * rng.randint(1, 9)
        for least, exponent in ((24, 3), (1, 3), (6, 4)):
            assert runs.text_runs(words, least, exponent) == plain_runs(words, least, exponent)


def test_common_extensions():
    rng = np.random.default_rng(3)
    codes = np.tile(rng.integers(0, 9, 50), 40)
    codes[1500] = 10
    assert runs.common(codes, 0, 50, 1) == 1450 and runs.common(codes, 1449, 1499, -1) == 1450
    assert runs.common(codes, 1501, 1551, 1) == 449 and runs.common(codes, 1550, 1600, -1) == 50


def test_query_against_the_definition(spark):
    rows = {r.doc_id: r for r in runs.op11_periodic_runs(spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows.values()) > 5
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        found = plain_runs(words)
        dropped = {k for s, q, size in found for k in range(s + q, s + size)}
        r = rows[d.doc_id]
        assert r.n_runs == len(found)
        best = min(found, key=lambda x: (-Fraction(x[2], x[1]), x[0], x[1]), default=None)
        want = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        assert (r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, q, size in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in dropped).encode()).hexdigest()


def test_edge_rows(spark):
    long = " ".join(["a b c"] * 20_000)
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, long, 5), (3, long, 5), (None, "x y z", 5), (4, "été " * 30, 5)], "id long, text string, runs int")
    out = runs.detect_runs(docs)
    assert out.columns == ["id", "text", "n_words", "runs", "collapsed"]
    rows = out.collect()
    assert [(r.n_words, r.collapsed) for r in rows if not r.text] == [(0, ""), (0, "")]
    assert [[tuple(x) for x in r.runs] for r in rows if r.id == 3] == [[(0, 60_000, 3)]] * 2
    assert {r.collapsed for r in rows if r.id == 3} == {"a b c"} and {r.collapsed for r in rows if r.id == 4} == {"été"}
    assert [(r.n_words, r.collapsed) for r in rows if r.id is None] == [(2, "x y z")]  # only ASCII white space separates
    assert runs.detect_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.detect_runs(docs, least_exponent=2)
