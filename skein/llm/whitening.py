"""Embedding whitening by shifted CholeskyQR.

The centred rows of the different vectors are orthogonalised by passes over all of them: a pass solves each row through
the triangular factors found so far, and Spark sums the Gram matrices of its tasks; the Cholesky factor of the sum, shifted
in the first pass so that it always exists, is the next factor. The product of the factors is the R of a QR
decomposition, and its singular value decomposition gives the principal components without the squared condition of a covariance.

What comes to the driver is one matrix of dimension by dimension a pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.shared import bound_batches, stored, table, tables_of_block

#: Entries become whole numbers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Passes of orthogonalisation at most; three are enough for rows of full rank.
PASSES = 8
#: Rows a Python worker gets at once.
BATCH = 2048
_LONG = 2**62
_EPS = float(np.finfo(np.float64).eps)


class Whitening(NamedTuple):
    """What the fit list teaches; its size depends on the dimension alone."""

    #: Number of different vectors, and their sum in each dimension, exact.
    n: int
    sums: list[int]
    #: (dimension, components): unit eigenvectors, each divided by the root of its eigenvalue.
    basis: np.ndarray
    explained: list[float]
    identity_error: float


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` numbers as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: in 64 bits where these hold it, else in Python's whole numbers."""
    most = max([abs(s) for s in sums] + [n * max(int(x.max(initial=0)), -int(x.min(initial=0)))])
    if most < _LONG // 2:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def deviations(d: np.ndarray) -> list[int | None]:
    """Sum of the squares of each row, exact; null where a long does not hold it."""
    if d.dtype != object and (d.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < _LONG:
        return (d * d).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in d]
    return [v if v < 2**63 else None for v in exact]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return numerators(x, n, sums).astype(np.float64) / n


def solve(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverse of each upper triangular factor in turn."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[0]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def summed(df: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of the symmetric matrices that ``part`` makes of their batches of vectors; ``df`` has only the vectors."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            if batch.num_rows:
                one = part(matrix(batch.column(0), width))
                total = one if total is None else total + one
        if total is not None:
            values = total[np.triu_indices(len(total))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["cell", "value"])

    rows = df.mapInArrow(cells, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    size = round((np.sqrt(8 * rows.num_rows + 1) - 1) / 2)
    out = np.zeros((size, size))
    values = np.zeros(rows.num_rows)
    values[rows.column("cell").to_numpy()] = rows.column("value").to_numpy()
    out[np.triu_indices(size)] = values
    return out + np.triu(out, 1).T


def whole_numbers(embeddings: DataFrame, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``embeddings`` with _whole, the vector in whole numbers; rows without a vector, and those with an entry that is null, not finite, or beyond what a long holds, are left out."""
    usable = f"forall({vector_col}, c -> coalesce(abs(cast(c AS double) * {scale}) < {_LONG}, false)) AND size({vector_col}) > 0"
    # a NaN is greater than any number
    return embeddings.where(usable).withColumn("_whole", F.expr(f"transform({vector_col}, c -> floor(cast(c AS double) * {scale}) + {offset})"))


def totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(number of vectors, sum of each dimension), exact."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), width)
            high, low = (x >> 31).sum(axis=0), (x & (2**31 - 1)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, len(x))), pa.array(high), pa.array(low)], ["place", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = fit.mapInArrow(parts, "place int, n long, high long, low long").groupBy("place").agg(F.sum("n").alias("n"), exact("high"), exact("low")).collect()  # one row a dimension
    rows.sort(key=lambda r: r["place"])
    return rows[0]["n"], [int(r["high"]) * 2**31 + int(r["low"]) for r in rows]


def triangular_factors(fit: DataFrame, n: int, sums: list[int]) -> tuple[list[np.ndarray], float]:
    """(the triangular factors of the centred rows, first one first; sum of the squares of all entries)."""
    width = len(sums)
    factors: list[np.ndarray] = []
    trace = 0.0
    for k in range(PASSES):
        held = list(factors)

        def gram(x: np.ndarray) -> np.ndarray:
            q = solve(centred(x, n, sums), held)
            return q.T @ q

        g = summed(fit, width, gram)
        values, vectors = np.linalg.eigh(g)
        if k == 0:
            trace = float(np.trace(g))
            if trace == 0:
                break
            shift = 11 * (n * width + width * (width + 1)) * _EPS * float(values[-1])
            g = g + shift * np.eye(width)
        else:
            # directions in which no row differs are left as they are
            nothing = values < 100 * width * _EPS * values[-1]
            if np.abs(values[~nothing] - 1).max() < 100 * width * _EPS:
                break
            g = g + vectors[:, nothing] @ vectors[:, nothing].T
        factors.append(np.linalg.cholesky(g).T)
    return factors, trace


def fit_whitening(embeddings: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """Components of the different vectors of ``embeddings``; None if no vector is usable or all are equal.

    The fit list has each vector of whole numbers once, so copies have no weight. Of several lengths the one that most different
    vectors have counts, then the longest. Directions in which no vector differs are no components.
    """
    spark = embeddings.sparkSession
    bound_batches(spark, BATCH)
    with tables_of_block(spark):
        fit = stored(whole_numbers(embeddings, vector_col, scale, offset).select("_whole").distinct())
        lengths = fit.groupBy(F.size("_whole").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).head(1)
        if not lengths:
            return None
        width = lengths[0]["width"]
        fit = fit.where(F.size("_whole") == width)
        n, sums = totals(fit, width)
        factors, trace = triangular_factors(fit, n, sums)
        if not factors:
            return None
        r = np.eye(width)
        for factor in factors:
            r = factor @ r
        _, sizes, vectors = np.linalg.svd(r)
        k = min(components, width)
        with np.errstate(divide="ignore"):
            basis = vectors[:k].T * (np.sqrt(n) / sizes[:k])

        def spread(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, sums) @ basis
            return y.T @ y

        seen = summed(fit, width, spread) / n
        some = np.diag(seen) > 0.5
        return Whitening(n, sums, basis[:, some], (sizes[:k][some] ** 2 / trace).tolist(), float(np.abs(seen[np.ix_(some, some)] - np.eye(some.sum())).max()))


def whiten(embeddings: DataFrame, model: Whitening, *, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The usable rows of ``embeddings`` with deviation (exact sum over dimensions of (n * x - sum)^2, null beyond a long) and whitened (array of the components' coordinates).

    Rows whose vector is null, empty, of another length than the model's, or holds an entry that is null or not finite are left out. Repeated rows
    and ids all stay; an empty table stays empty. Input columns named like a result give way to it.
    """
    bound_batches(embeddings.sparkSession, BATCH)
    n, sums, basis = model.n, model.sums, model.basis

    @F.pandas_udf("deviation long, whitened array<double>")
    def coordinates(vectors: pd.Series) -> pd.DataFrame:
        x = np.array(vectors.tolist(), dtype=np.int64).reshape(-1, len(sums))
        d = numerators(x, n, sums)
        return pd.DataFrame({"deviation": pd.array(deviations(d), dtype="Int64"), "whitened": list((d.astype(np.float64) / n) @ basis)})

    rows = whole_numbers(embeddings, vector_col, scale, offset).where(F.size("_whole") == len(sums)).withColumn("_coordinates", coordinates("_whole"))
    kept = [c for c in embeddings.columns if c not in ("deviation", "whitened")]
    return rows.select(*kept, F.col("_coordinates.deviation").alias("deviation"), F.col("_coordinates.whitened").alias("whitened"))


def op12_whiten(spark, sf_dir: str) -> DataFrame:
    """Coordinates of every embedding on the first components, whitened."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit_whitening(df)
    if model is None:
        schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.limit(0).select("vec_id", *[F.lit(None).cast(kind).alias(c) for c, kind in (f.split(" ") for f in schema.split(", "))])
    shares = F.array(*map(F.lit, model.explained))
    rows = whiten(df, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(model.identity_error).alias("identity_error")
    )
