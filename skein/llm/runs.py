"""Periodic runs of words: stretches that repeat themselves, found through Lyndon roots.

The first phase of a suffix sorter (Baier's grouping) puts the suffixes of a word sequence into groups from the
greatest to the least; the width of the group in which a suffix ends is the length of the longest Lyndon word that
starts there. Taken once under an order of the words and once under its reverse, these words hold a root of
every run: where two equal ones follow each other, the run is what the common extensions to both sides reach.

Texts are independent of each other, so Spark deals them out in Arrow batches and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.shared import bound_batches, table

#: Words a run has at least, and how often it holds its period at least.
LEAST_WORDS = 24
LEAST_EXPONENT = 3
_RESULTS = ("n_words", "runs", "collapsed")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lyndon_words(codes: list[int]) -> tuple[list[int], list[int]]:
    """(length, group) of the longest Lyndon word that starts at each place; places have one group if their words are equal.

    The groups are visited from the greatest to the least. Every suffix of a group points to the nearest place before it
    that is in a lower group; there its word is appended. Places that got equally many words, and were in one group, form a
    new one right above it. Places of visited groups leave the chain ``left``/``right``, so the pointer is the neighbour in it.
    """
    n = len(codes)
    left, right = list(range(-1, n)), list(range(1, n + 2))  # place n, which is also place -1, closes the chain
    members: list[list[int]] = [[] for _ in range(max(codes, default=-1) + 1)]
    for i, c in enumerate(codes):
        members[c].append(i)
    group, length, width = list(codes), [1] * n, [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    g = len(members) - 1
    while g >= 0:
        w, before, many = width[g], -1, 0
        moved: dict[tuple[int, int], list[int]] = {}
        for i in members[g]:
            if group[i] != g:
                continue
            j, r = left[i], right[i]
            right[j], left[r], length[i] = r, j, w
            if j == before:
                many += 1
                continue
            if before >= 0:
                moved.setdefault((many, group[before]), []).append(before)
            before, many = j, 1
        if before >= 0:
            moved.setdefault((many, group[before]), []).append(before)
        for many, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            new, up, places = len(width), above[old], moved[many, old]
            width.append(width[old] + many * w)
            members.append(places)
            above.append(up)
            below.append(old)
            above[old] = below[up] = new  # there is always a group above: the one that is visited
            for j in places:
                group[j] = new
        g = below[g]
    return length, group


def common(codes: np.ndarray, a: int, b: int, step: int) -> int:
    """How many equal codes follow from the places a < b on, to the right (step 1) or to the left (step -1)."""
    room = len(codes) - b if step > 0 else a + 1
    done, size = 0, 8
    while done < room:
        size = min(size, room - done)
        if step > 0:
            x, y = codes[a + done : a + done + size], codes[b + done : b + done + size]
        else:
            x, y = codes[a - done - size + 1 : a - done + 1][::-1], codes[b - done - size + 1 : b - done + 1][::-1]
        if size <= 8 or not np.array_equal(x, y):
            other = np.flatnonzero(x != y)
            if len(other):
                return done + int(other[0])
        done += size
        size *= 2
    return done


def maximal_runs(codes: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> set[tuple[int, int, int]]:
    """(start, period, length) of every run of a sequence of codes 0, 1, ..., each of which occurs.

    A run of exponent three holds its root at least twice in a row, so a root is looked for only where a place and the one after
    its word are in the same group, and of such a chain only at its first place.
    """
    found = set()
    n, top = len(codes), int(codes.max(initial=-1))
    for order in (codes, top - codes):
        length, group = (np.array(x) for x in lyndon_words(order.tolist()))
        i = np.flatnonzero(np.arange(n) + 2 * length <= n)
        i = i[group[i] == group[i + length[i]]]
        p = length[i]
        first = (i < p) | (group[i - np.minimum(p, i)] != group[i])
        for a, q in zip(i[first].tolist(), p[first].tolist()):
            start = a - common(codes, a - 1, a + q - 1, -1) if a else 0
            size = a - start + q + common(codes, a, a + q, 1)
            if size >= max(least_words, least_exponent * q):
                found.add((start, q, size))
    return found


def repeated_stretches(hashes: np.ndarray, gram: int, least_words: int) -> list[tuple[int, int]]:
    """Stretches of at least ``least_words`` places, all of them in sequences of ``gram`` words that occur twice in the text.

    Equal hashes may only lengthen a stretch. A run of n words and period q holds every ``gram`` of it twice if n >= 2q + gram - 1, so it lies within a stretch.
    """
    n = len(hashes) - gram + 1
    if n < 2:
        return []
    grams = hashes[:n].copy()
    for k in range(1, gram):
        grams *= _ODD
        grams += hashes[k : k + n]
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    at = np.flatnonzero(np.isin(grams, twice))
    edges[at] += 1
    edges[at + gram] -= 1
    inside = np.concatenate(([0], np.cumsum(edges[:-1]) > 0, [0])).astype(np.int8)
    starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= least_words]


def text_runs(words: list[bytes], least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, period, length) of every run of a word sequence, ordered."""
    if len(words) < least_words:
        return []
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    out: set[tuple[int, int, int]] = set()
    for a, b in repeated_stretches(hashes, max(1, (least_words + 5) // 3), least_words):
        known: dict[bytes, int] = {}
        codes = np.array([known.setdefault(w, len(known)) for w in words[a:b]])
        out.update((a + start, q, size) for start, q, size in maximal_runs(codes, least_words, least_exponent))
    return sorted(out)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, q, size in runs:
        edges[start + q] += 1
        edges[start + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def detect_runs(docs: DataFrame, *, text_col: str = "text", least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``docs`` with n_words, runs (array of start, length and period, by start, then period) and collapsed (the text without repetitions).

    Words are what stands between blanks, tabs and line ends. A run has ``least_words`` words and ``least_exponent`` (3 or more) times its smallest
    period at least, and cannot be extended. The collapsed text keeps the first period of each run, with one blank between words; where
    runs overlap, a word goes if any of them drops it.

    Null and empty texts have no words, no runs and an empty collapsed text. Equal texts get equal values, rows are never merged, an empty
    table stays empty. Input columns named like a result give way to it. Texts of any length are taken whole; time and memory grow with the longest one.
    """
    if least_exponent < 3 or least_words < 1:
        raise ValueError("runs have three periods and one word at least")
    bound_batches(docs.sparkSession)

    @F.pandas_udf("n_words long, start array<long>, length array<long>, period array<long>, collapsed binary")
    def runs_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                words = text.split() if text else []  # of bytes: at ASCII white space only
                runs = text_runs(words, least_words, least_exponent)
                rows.append((len(words), [r[0] for r in runs], [r[2] for r in runs], [r[1] for r in runs], b" ".join(collapse(words, runs))))
            yield pd.DataFrame(rows, columns=["n_words", "start", "length", "period", "collapsed"])

    found = docs.withColumn("_runs", runs_of(F.col(text_col).cast("string").cast("binary")))
    kept = [F.col(c) for c in docs.columns if c not in _RESULTS]
    return found.select(*kept, F.col("_runs.n_words").alias("n_words"), F.arrays_zip("_runs.start", "_runs.length", "_runs.period").alias("runs"), F.col("_runs.collapsed").cast("string").alias("collapsed"))


def plant_period(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every tenth text, by the CRC-32 of its id, made periodic from some word on; texts without words and rows without an id stay as they are."""
    words = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    df = docs.withColumn("_w", F.when(chosen, words)).withColumn("_n", F.size("_w").cast("long"))
    df = df.withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n"))).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    part = lambda a, n: F.slice("_w", (a + 1).cast("int"), n.cast("int"))
    a, p, rest = F.col("_a"), F.col("_p"), F.col("_n") - F.col("_a")
    whole = F.expr("cast((_n - _a) div _p as int)")
    made = F.concat(part(F.lit(0), a), F.flatten(F.array_repeat(part(a, p), whole)), part(a, rest - whole * p))
    return df.withColumn(text_col, F.when(F.col("_n") > 0, F.array_join(made, " ")).otherwise(F.col(text_col))).drop("_w", "_n", "_a", "_p")


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, every tenth of which is made periodic first."""
    docs = plant_period(table(spark, sf_dir, "documents").select("doc_id", "text"))
    more = "a.length * b.period > b.length * a.period"
    df = detect_runs(docs).withColumn(
        "_best", F.expr(f"get(array_sort(runs, (a, b) -> CASE WHEN {more} THEN -1 WHEN a.length * b.period < b.length * a.period THEN 1 WHEN a.start <> b.start THEN cast(sign(a.start - b.start) AS int) ELSE cast(sign(a.period - b.period) AS int) END), 0)")
    )
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    return df.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period", F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
