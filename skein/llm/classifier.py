"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every token has a sparse random index vector. A token's word vector is the sum of the
index vectors of its neighbours over the whole corpus: each task adds them up in a table of
fixed size, and Spark sums the tables. A document is pooled from its tokens' word vectors alone: their
mean, and the mean product of neighbouring ones, which tells how its words follow each other. A two-layer network in numpy
learns the quality from a bounded sample of labelled documents; a temperature, fitted on a part that the
training leaves out, calibrates its probabilities.

Tokens are hashed into a fixed number of rows, so the vectors have the same size at every
scale of the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.shared import bound_batches, checkpointed, table

ROWS = 4096
DIM = 32
NONZERO = 2
#: Numbers of a document: two pooled vectors.
WIDTH = 2 * DIM
REACH = 2
#: Labelled documents the network may learn from.
SAMPLE = 6_000
HIDDEN = 24
EPOCHS = 60
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_KEPT_TOKENS = 200_000
#: Stands between documents.
GAP = -1
#: Tokens that are added to the table at once.
_HELD = 200_000
#: Tokens that are pooled at once.
_POOLED = 1 << 16


class Tokens:
    """Token identifiers of texts; remembers a bounded number of tokens."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def rows(self, text: str | None) -> np.ndarray:
        """The row of each token in order; upper and lower case are different tokens."""
        tokens = _TOKEN.findall(text) if text else []
        known = self.known
        new = set(tokens).difference(known)
        if len(known) + len(new) > _KEPT_TOKENS:
            known.clear()
            new = set(tokens)
        for t in new:
            known[t] = zlib.crc32(t.encode("utf-8", "replace")) % ROWS
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def index_entries(seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """The few entries of every row's ternary index vector: (places, signs) for each of them."""
    rng = np.random.default_rng(seed)
    return [(rng.integers(0, DIM, ROWS), rng.choice(np.array([-1.0, 1.0]), ROWS)) for _ in range(NONZERO)]


def index_vectors() -> np.ndarray:
    out = np.zeros((ROWS, DIM), dtype=np.float32)
    for places, signs in index_entries():
        out[np.arange(ROWS), places] += signs
    return out


def _context_sums(ids: np.ndarray, entries: list, sums: np.ndarray) -> None:
    """Adds to every token's row the index vectors of its neighbours."""
    for k in range(1, REACH + 1):
        inside = (ids[:-k] != GAP) & (ids[k:] != GAP)
        a, b = ids[:-k][inside], ids[k:][inside]
        for places, signs in entries:
            sums += np.bincount(a * DIM + places[b], weights=signs[b], minlength=ROWS * DIM)
            sums += np.bincount(b * DIM + places[a], weights=signs[a], minlength=ROWS * DIM)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(ROWS, DIM) word vectors of unit length, from all documents.

    What comes to the driver is one table of fixed size, whatever the corpus.
    """
    names = [f"v{i}" for i in range(DIM)]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, entries, out = Tokens(), index_entries(), np.zeros(ROWS * DIM)
        held, n, gap = [], 0, np.full(REACH, GAP)
        for batch in batches:
            for text in batch["_text"]:
                ids = tokens.rows(text)
                held += [ids, gap]
                n += len(ids)
                if n > _HELD:
                    _context_sums(np.concatenate(held), entries, out)
                    held, n = [], 0
        if n:
            _context_sums(np.concatenate(held), entries, out)
        out = out.reshape(ROWS, DIM)
        used = np.flatnonzero(np.abs(out).sum(axis=1))
        yield pd.DataFrame(out[used], columns=names).assign(word=used)

    schema = ", ".join(f"{n} double" for n in names) + ", word long"
    parts = docs.select(F.col(text_col).cast("string").alias("_text")).mapInPandas(sums, schema)
    rows = parts.groupBy("word").agg(*[F.sum(n).alias(n) for n in names]).collect()
    out = np.zeros((ROWS, DIM))
    for r in rows:
        out[r["word"]] = [r[n] for n in names]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def document_vector(text: str | None, tokens: Tokens, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of the tokens, and mean product of neighbouring ones; zeros for a text without tokens, or without neighbours."""
    rows = tokens.rows(text)
    n = len(rows)
    out = np.zeros(WIDTH, dtype=np.float64)
    for k in range(0, n, _POOLED):
        part = vectors[rows[k : k + _POOLED + 1]]  # with the first token of the next part
        out[:DIM] += part[:_POOLED].sum(axis=0, dtype=np.float64)
        out[DIM:] += np.einsum("ij,ij->j", part[1:], part[:-1], dtype=np.float64)
    out[:DIM] /= max(n, 1)
    out[DIM:] /= max(n - 1, 1)
    return out.astype(np.float32)


class Network:
    """Two layers with a calibrating temperature."""

    def __init__(self, seed: int = 11):
        self.seed, self.temperature, self.constant = seed, 1.0, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Trains on four fifths of the rows and fits the temperature on the rest. With labels of one kind the score is their share."""
        if len(y) == 0 or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return self
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        calibration = np.arange(len(y)) % 5 == 0
        xt, yt = x[~calibration], y[~calibration]
        self.w1 = rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), 0.0
        params = ["w1", "b1", "w2", "b2"]
        m, v, step = {p: 0.0 for p in params}, {p: 0.0 for p in params}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(yt))
            for k in range(0, len(order), 64):
                xb, yb = xt[order[k : k + 64]], yt[order[k : k + 64]]
                hidden = np.maximum(xb @ self.w1 + self.b1, 0)
                d = (1 / (1 + np.exp(-(hidden @ self.w2 + self.b2))) - yb) / len(yb)
                dh = np.outer(d, self.w2) * (hidden > 0)
                grads = {"w1": xb.T @ dh + 1e-4 * self.w1, "b1": dh.sum(axis=0), "w2": hidden.T @ d + 1e-4 * self.w2, "b2": d.sum()}
                step += 1
                for p, g in grads.items():
                    m[p] = 0.9 * m[p] + 0.1 * g
                    v[p] = 0.999 * v[p] + 0.001 * g * g
                    setattr(self, p, getattr(self, p) - 0.004 * (m[p] / (1 - 0.9**step)) / (np.sqrt(v[p] / (1 - 0.999**step)) + 1e-8))
        logits, held = self._logits(x[calibration]), y[calibration]
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, logits / t) - held * logits / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -30, 30)
        return 1 / (1 + np.exp(-z))


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of the id as text is divisible by 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _label_sample(labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled ids outside the held-out fifth, drawn by hash."""
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label")).where(F.col("_label").isin(0.0, 1.0) & ~held_out(F.col("_id")))
    ids = ids.groupBy("_id").agg(F.max("_label").alias("_label"))
    return ids.orderBy(F.xxhash64("_id"), "_id").limit(sample)


class Model(NamedTuple):
    """What a corpus and its labels teach: word vectors and a network, both of fixed size."""

    vectors: np.ndarray
    network: Network


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Word vectors from all documents, and a network that learns from at most ``sample`` labelled ids, on the driver.

    Labels other than 0 and 1 are ignored, and so is the held-out fifth of the ids; of several labels of an id the highest counts, and of
    several documents of an id the one whose text has the smallest hash.
    """
    bound_batches(docs.sparkSession)
    vectors = word_vectors(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    chosen = F.broadcast(checkpointed(_label_sample(labels, id_col, label_col, sample)))  # at most ``sample`` rows

    @F.pandas_udf("array<float>")
    def pooled(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = Tokens()
        for batch in texts:
            yield pd.Series([document_vector(t, tokens, held.value) for t in batch], dtype=object)

    text = F.col(text_col).cast("string")
    labelled = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(chosen, "_id").select("_id", "_label", F.xxhash64("_text").alias("_hash"), pooled("_text").alias("_vector"))
    one = labelled.groupBy("_id", "_label").agg(F.min_by("_vector", "_hash").alias("_vector"))
    rows = sorted(one.collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0])))  # at most ``sample`` rows
    x, y = np.array([r[2] for r in rows], dtype=np.float64).reshape(len(rows), WIDTH), np.array([r[1] for r in rows])
    return Model(vectors, Network().fit(x, y))


def quality_score(text: Column, model: Model, spark: SparkSession) -> Column:
    """The score of a text, from 0 to 1."""
    bound_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens, (vectors, network) = Tokens(), held.value
        for batch in texts:
            x = np.array([document_vector(t, tokens, vectors) for t in batch], dtype=np.float64)
            yield pd.Series(np.round(network.predict(x), 9) if len(x) else [], dtype="float64")

    return score(text.cast("string"))


def score_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE, model: Model | None = None
) -> DataFrame:
    """``docs`` with held_out, score and predicted, by a ``model`` or by one that is fitted to them (see fit_quality).

    Only the text enters a score. Null and empty texts get the score of a document without tokens, repeated rows
    the same score. Without any labels every score is one half. Input columns named like a result column give way to it.
    An empty table gives an empty one. Very long texts are pooled in parts.
    """
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    model = model or fit_quality(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    out = docs.select(*kept, held_out(F.col(id_col)).alias("held_out"), quality_score(F.col(text_col), model, docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality_score(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
