"""Quality rules: countable base rules, and a linear classifier over hashed word and character n-grams.

The words and word pairs of a text, and its sequences of two to four characters, are hashed into a table of fixed size;
the root of each one's share is a feature. A logistic regression learns from a bounded sample of labelled documents, Platt's two numbers, fitted on
a part that the training leaves out, calibrate it, and texts are scored in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.shared import bound_batches, checkpointed, table
from skein.llm.classifier import _label_sample

#: Hashed places for words and pairs of words, and for sequences of characters.
WORD_PLACES, CHAR_PLACES = 1024, 3072
CHAR_SIZES = (2, 3, 4)
#: Labelled documents the regression may learn from.
SAMPLE = 4_000
EPOCHS = 40
#: A text is kept from this probability of label 1 on.
THRESHOLD = 0.7
LEAST_WORDS = 50
#: Share of words in repeated windows, in hundredths, beyond which a text fails.
MOST_REPEATED = 50
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Characters that are hashed at once.
_PART = 1 << 20
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_RESULTS = (*_COUNTS, "base_failed", "probability", "kept")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the sequence holds at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    size = len(known)
    pairs = codes[:-1] * size + codes[1:]
    if size >= 1 << 20:  # the next product could exceed 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + codes[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.isin(windows, twice)
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k : k + n] |= at
    return int(inside.sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text and its words."""
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return len(words), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _places(hashes: np.ndarray, places: int) -> np.ndarray:
    """Counts of 64-bit hashes by place."""
    return np.bincount(((hashes * _ODD) >> np.uint64(40)).astype(np.int64) % places, minlength=places)


def features(text: str, words: list[bytes]) -> np.ndarray:
    """Roots of the shares of hashed words and pairs, then of hashed character sequences; zeros for a text without any."""
    by_word, by_char = np.zeros(WORD_PLACES), np.zeros(CHAR_PLACES)
    hashes = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    by_word += _places(hashes, WORD_PLACES)
    by_word += _places(hashes[:-1] * _ODD + hashes[1:], WORD_PLACES)
    most = max(CHAR_SIZES)
    for k in range(0, len(text), _PART):
        chars = np.frombuffer(text[k : k + _PART + most - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        rolled = chars
        for size in range(2, most + 1):
            rolled = rolled[:-1] * _ODD + chars[size - 1 :]
            if size in CHAR_SIZES:
                by_char += _places(rolled[:_PART], CHAR_PLACES)
    return np.sqrt(np.concatenate([x / max(x.sum(), 1) for x in (by_word, by_char)])).astype(np.float32)


class Regression(NamedTuple):
    """Weights and intercept of a calibrated logistic regression."""

    weights: np.ndarray
    intercept: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.intercept, -30, 30)))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a * margin + b))) by Newton steps, labels drawn a little towards the middle."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    design, ab = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    loss = lambda v: float(np.sum(np.logaddexp(0, design @ v) - target * (design @ v)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ ab, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (p - target))
        size = 1.0
        while size > 1e-6 and loss(ab - size * step) > loss(ab):
            size /= 2
        ab = ab - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(ab[0]), float(ab[1])


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Regression:
    """Learns from four fifths of the rows and calibrates on the rest. With labels of one kind, or fewer than ten rows, the probability is their share."""
    x, calibration = x.astype(np.float32), np.arange(len(y)) % 5 == 0
    if len(y) < 10 or min(len(set(y[calibration])), len(set(y[~calibration]))) < 2:
        return Regression(np.zeros(x.shape[1]), float(np.log((y.sum() + 1) / ((1 - y).sum() + 1))))
    rng = np.random.default_rng(seed)
    xt, yt = x[~calibration], y[~calibration]
    mean, scale = xt.mean(axis=0), xt.std(axis=0) + 1e-3
    w, b, step = np.zeros(x.shape[1]), 0.0, 0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for _ in range(EPOCHS):
        order = rng.permutation(len(yt))
        for k in range(0, len(order), 128):
            rows, labels = (xt[order[k : k + 128]] - mean) / scale, yt[order[k : k + 128]]
            d = 1 / (1 + np.exp(-np.clip(rows @ w + b, -30, 30))) - labels
            grad = np.append(rows.T @ d / len(d) + 1e-3 * w, d.mean())
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            move = 0.002 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    w, b = w / scale, b - float((mean / scale) @ w)
    slope, offset = platt(x[calibration] @ w + b, y[calibration])
    return Regression(slope * w, slope * b + offset)


def _words(text: str | None) -> tuple[str, list[bytes]]:
    text = text or ""
    return text, text.encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space only


def fit_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Regression:
    """A regression on at most ``sample`` labelled ids, on the driver.

    The fifth of the ids whose CRC-32 as text is divisible by 5 is never learnt from, and labels other than 0 and 1 are ignored; of several
    labels of an id the highest counts, and of several documents of an id the one whose text has the smallest hash.
    """
    bound_batches(docs.sparkSession)
    chosen = F.broadcast(checkpointed(_label_sample(labels, id_col, label_col, sample)))  # at most ``sample`` rows

    @F.pandas_udf("binary")
    def vector(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([features(*_words(t)).tobytes() for t in batch], dtype=object)

    labelled = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(chosen, "_id")
    one = labelled.groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")).select("_id", "_label", vector("_text").alias("_vector"))
    rows = sorted(one.collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0])))  # at most ``sample`` rows of fixed size
    x = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.float32).reshape(len(rows), WORD_PLACES + CHAR_PLACES)
    return train(x, np.array([r[1] for r in rows], dtype=np.float64))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def apply_rules(docs: DataFrame, model: Regression, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability and kept.

    A text is kept if it passes the base rules and its probability of label 1 is ``threshold`` or more. Null and empty texts have no words and fail.
    Repeated rows get the same values; an empty table stays empty. Input columns named like a result give way to it. Whole texts are read, long ones in parts.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(", ".join(f"{c} long" for c in _COUNTS) + ", probability double")
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            pairs = [_words(t) for t in batch]
            counts = pd.DataFrame([base_counts(*p) for p in pairs], columns=_COUNTS, dtype="int64")
            x = np.array([features(*p) for p in pairs], dtype=np.float32).reshape(len(pairs), WORD_PLACES + CHAR_PLACES)
            yield counts.assign(probability=np.round(held.value.probability(x), 9))

    found = docs.withColumn("_judged", judged(F.col(text_col).cast("string")))
    out = found.select(*[F.col(c) for c in docs.columns if c not in _RESULTS], *[F.col(f"_judged.{c}").alias(c) for c in (*_COUNTS, "probability")])
    out = out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts of every document and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_rules(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, model).select("doc_id", *_COUNTS, "base_failed", "kept", "probability")
