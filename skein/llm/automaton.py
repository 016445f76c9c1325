"""Benchmark decontamination with a generalised suffix automaton over words.

The items' words become integers and all items go into one automaton. A document's
words are streamed through it; the automaton gives, at every word, the length of the
longest run of words ending there that also stands in an item. Where it reaches the
window's length, the words of the window are hit, and the state's suffix says which
items hold that window. Documents without the opening words of any window cannot hold
one; a vectorised test on those words spares them the walk.

Items are cut into groups of bounded size, one automaton and one pass for each, so
neither the driver nor a task ever holds more than one group. A worker process builds
a group's automaton once and keeps it for its later tasks.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.shared import bound_batches, checkpointed, table

#: Words are runs of ASCII letters and digits and of everything beyond ASCII; all other bytes become spaces, letters lower case.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
WINDOW = 10
#: Words of the opening of a window that a document must hold to be walked.
OPENING = 4
#: Bytes of items that one automaton may be built from.
GROUP_BYTES = 8_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, ASCII letters lower-cased; null has none."""
    return data.translate(_FOLDED).split() if data else []


class Automaton:
    """Suffix automaton of several word sequences, in flat arrays, with the items of every window.

    Most states have one edge, which stands in two arrays; further edges stand in dictionaries of their own.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window, self.ids = window, []
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link = array("i", [0]), array("i", [-1])
        self.word, self.to = array("i", [-1]), array("i", [-1])  # by state: its first edge
        self.more: dict[int, dict[int, int]] = {}  # by state: its further edges
        tokens, short = [], {}
        for item_id, text in items:
            if words := [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]:
                self.ids.append(item_id)
                tokens.append(array("i", words))
                last = 0
                for w in words:
                    last = self._extend(last, w)
        self._find_ancestors()
        self.items: dict[int, set[int]] = {}  # by state of a window: the items that hold it
        for k, words in enumerate(tokens):
            state = 0
            for n, w in enumerate(words, 1):
                state = self.follow(state, w)
                if n >= window:
                    self.items.setdefault(self.anchor[state], set()).add(k)
            if len(words) < window:
                short.setdefault(state, {}).setdefault(len(words), []).append(k)
        self.short = {state: sorted(marks.items()) for state, marks in short.items()}  # by state: (words, items) of items under a window
        self._find_marked()
        self.openings = np.unique(np.concatenate([self._grams(np.array(t, dtype=np.int64)) for t in tokens] or [np.empty(0, np.uint64)]))

    def follow(self, state: int, w: int) -> int:
        """The state that a word leads to, or -1."""
        if self.word[state] == w:
            return self.to[state]
        edges = self.more.get(state)
        return edges.get(w, -1) if edges else -1

    def _lead(self, state: int, w: int, target: int) -> None:
        if self.word[state] in (w, -1):
            self.word[state], self.to[state] = w, target
        else:
            self.more.setdefault(state, {})[w] = target

    def _extend(self, last: int, w: int) -> int:
        link, length = self.link, self.length
        q = self.follow(last, w)
        if q >= 0:
            return q if length[last] + 1 == length[q] else self._clone(last, q, w)
        cur = self._state(length[last] + 1)
        p = last
        while p >= 0 and (q := self.follow(p, w)) < 0:
            self._lead(p, w, cur)
            p = link[p]
        if p >= 0:
            link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, w)
        return cur

    def _state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.word.append(-1)
        self.to.append(-1)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        c = self._state(self.length[p] + 1)
        self.word[c], self.to[c] = self.word[q], self.to[q]
        if q in self.more:
            self.more[c] = dict(self.more[q])
        self.link[c] = self.link[q]
        self.link[q] = c
        while p >= 0 and self.follow(p, w) == q:
            self._lead(p, w, c)
            p = self.link[p]
        return c

    def _by_length(self) -> list[int]:
        """States, each behind the one that its suffix link leads to."""
        return np.argsort(np.frombuffer(self.length, dtype=np.int32), kind="stable").tolist()

    def _find_ancestors(self) -> None:
        """anchor: for a state of at least a window's length, the one that holds the window which its words end with."""
        length, link, window = self.length, self.link, self.window
        self.anchor = anchor = array("i", [0]) * len(length)
        for s in self._by_length():
            if length[s] >= window:
                anchor[s] = anchor[link[s]] if length[link[s]] >= window else s

    def _find_marked(self) -> None:
        """marked: for every state the nearest one on its chain of suffix links, itself included, at which a short item ends; 0 for none."""
        self.marked = marked = array("i", [0]) * len(self.length)
        if self.short:
            for s in self._by_length()[1:]:
                marked[s] = s if s in self.short else marked[self.link[s]]

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        """Hashes of all runs of OPENING known words, or of the whole sequence where it is shorter."""
        n = min(OPENING, len(ids))
        known = ids >= 0
        for k in range(1, n):
            known = known[:-1] & (ids[k:] >= 0)
        at = np.flatnonzero(known)
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            out = out * _MIX + (ids[at + k] + 1).astype(np.uint64)
        return out

    def may_hold(self, ids: np.ndarray) -> bool:
        """Whether the opening of a window is among the words (identifiers, -1 for unknown words)."""
        if self.short and min(marks[0][0] for marks in self.short.values()) < OPENING:
            return bool((ids >= 0).any())
        if len(ids) < OPENING or not len(grams := self._grams(ids)):
            return False
        near = np.minimum(np.searchsorted(self.openings, grams), len(self.openings) - 1)
        return bool((self.openings[near] == grams).any())

    def walk(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest match) at every word that ends a match of an item. A suffix link shortens the match, so all links together are no more than the words."""
        follow, link, length = self.follow, self.link, self.length
        state = matched = 0
        for at, w in enumerate(ids):
            if w < 0:
                state = matched = 0
                continue
            while (to := follow(state, w)) < 0 and state:
                state = link[state]
                matched = length[state]
            if to >= 0:
                state = to
                matched += 1
                yield at, state, matched

    def hits(self, ids: list[int]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in a window's occurrence, and the items whose windows occur. Each word takes one step for the windows and at most one for each length of a short item."""
        edge = [0] * (len(ids) + 1)
        windows: set[int] = set()
        found: set[int] = set()
        window, anchor, marked, link = self.window, self.anchor, self.marked, self.link
        for at, state, matched in self.walk(ids):
            if matched >= window:
                windows.add(anchor[state])
                edge[at - window + 1] += 1
                edge[at + 1] -= 1
            s = marked[state]
            while s:
                for n, items in self.short[s]:
                    if n <= matched:
                        edge[at - n + 1] += 1
                        edge[at + 1] -= 1
                        if items[0] not in found:
                            found.update(items)
                s = marked[link[s]]
        for s in windows:
            found |= self.items[s]
        return np.cumsum(edge[:-1]) > 0, found


#: The automaton that this worker process has built last, by the name of its group.
_KEPT: dict[str, Automaton] = {}


def kept_automaton(name: str, items: list[tuple[str | None, bytes]], window: int) -> Automaton:
    """The automaton of a group, built by the first task of a worker process that asks for it and kept for the tasks that follow."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Automaton(items, window)
    return _KEPT[name]


def _groups(benchmark: DataFrame, id_col: str, text_col: str, group_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in groups of bounded size, read from Spark row by row; one group without items for an empty table."""
    group: list[tuple[str | None, bytes]] = []
    held = 0
    for item_id, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string").cast("binary")).where(F.col(text_col).isNotNull()).toLocalIterator():
        if group and held + len(text) > group_bytes:
            yield group
            group, held = [], 0
        group.append((item_id, bytes(text)))
        held += len(text)
    yield group


SPANS = "n_words long, spans array<struct<start:int,stop:int>>, items array<string>"


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "item_id", item_text: str = "text", text_col: str = "text", window: int = WINDOW, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated, spans (word ranges) and items.

    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one
    window. Null and empty texts have no words and are never hit; such items have no window. Items
    with equal texts all count. An item without an id is hit like others, but neither counted nor
    listed. Input columns named like a result column give way to it. An empty benchmark hits nothing. Repeated
    documents are each scanned; an empty table gives an empty one. Very long and repetitive texts take time in proportion to their words.

    The benchmark is read in groups of ``group_bytes`` bytes. A pass over the documents
    broadcasts one group; further groups take further passes, which add to the spans found so far, with
    a checkpoint between them. So the driver and a task hold one group at most.
    """
    bound_batches(docs.sparkSession)
    out_names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"]
    kept = [c for c in docs.columns if c not in out_names]
    df = docs.select(*kept, F.array().cast("array<struct<start:int,stop:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for n, group in enumerate(_groups(benchmark, id_col, item_text, group_bytes)):
        if n:
            df = checkpointed(df.select(*kept, "spans", "items"))
        df = df.withColumn("_scan", _scanner(df.sparkSession.sparkContext.broadcast(group), window)(F.col(text_col).cast("string").cast("binary"), "spans", "items"))
        df = df.select(*kept, "_scan.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    df = df.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
    return df.withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256)).select(*kept, *out_names)


def _scanner(group, window: int):
    name = uuid.uuid4().hex

    @F.pandas_udf(SPANS)
    def scan(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = kept_automaton(name, group.value, window)
        for texts, spans, items in parts:
            yield pd.DataFrame([scan_text(t, automaton, s, i) for t, s, i in zip(texts, spans, items)], columns=["n_words", "spans", "items"])

    return scan


def scan_text(data: bytes | None, automaton: Automaton, spans=(), items=()) -> tuple[int, list[dict], list[str]]:
    """Words, hit word ranges and sorted ids of the items of a text, those known so far included."""
    words = words_of(data)
    known = np.fromiter(map(automaton.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    if words and automaton.may_hold(known):
        hit, found = automaton.hits(known.tolist())
        if found:
            for s in spans:
                hit[s["start"] : s["stop"]] = True
            turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            spans = [{"start": int(a), "stop": int(b)} for a, b in zip(turns[::2], turns[1::2])]
            items = sorted({*items, *(x for k in found if (x := automaton.ids[k]) is not None)})
    return len(words), list(spans), list(items)


def remove_spans(text: str | None, spans) -> str | None:
    """The text without the words of the spans (word ranges) and what stands between them."""
    if not text or not len(spans):
        return text
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data)]
    out, last = [], 0
    for s in spans:
        out.append(data[last : at[s["start"]][0]])
        last = at[s["stop"] - 1][1]
    return b"".join([*out, data[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, max_coverage: float = 0.5, min_span: int = 1, text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with the hit spans cut out of the text; documents hit over ``max_coverage`` of their words go.

    Spans shorter than ``min_span`` words stay; by default none do. An n_chars column is set to the new length. Null and empty texts stay, repeated rows are treated alike, an empty table gives
    an empty one, and all columns come back, also those that are named like a result of find_contamination.
    """
    packed = docs.select(F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    scanned = find_contamination(packed, benchmark, text_col="_text", **kw).where(F.col("n_hit") <= max_coverage * F.col("n_words"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([remove_spans(t, [s for s in sp if s["stop"] - s["start"] >= min_span]) for t, sp in zip(texts, spans)], dtype=object)

    out = scanned.withColumn("_new", F.when(F.col("contaminated"), cut("_text", "spans")).otherwise(F.col("_text")))
    new = {text_col: F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("contaminated"), F.length("_new")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM iw
), dw AS (
  SELECT n, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT n, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), h AS (SELECT dw.n, dw.i, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g
), c AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + k)) AS p FROM h) GROUP BY n
), t AS (SELECT n, count(DISTINCT item_id) AS n_items, sha256(coalesce(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR), '')) AS s FROM h GROUP BY n
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (n) LEFT JOIN t USING (n)
"""
