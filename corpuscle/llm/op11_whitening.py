"""Embedding whitening by TSQR: exact sums, a QR of each partition, merged R factors, one SVD.

Components become integers first, and the fit list holds each distinct integer vector
once. Its size n and its sums S are exact, so a centred row is (n*x - S) / n with an exact
numerator. Each task folds its rows, block by block, into one triangular factor of d by d;
factors are merged ``FAN`` at a time in a tree of Spark stages, and the last one, d by d at
any number of rows, comes to the driver. Its right singular vectors are the components,
its squared singular values over n the eigenvalues; no covariance of the vectors is formed.
Whitening is a map over all rows with the sums and the few components broadcast.

Defined cases: rows whose vector is null or holds a null or non-finite entry are left out;
a null id is an id like others, and rows that repeat are returned each; a vector shorter
than the longest counts as having zeros at its end (an empty one is all zeros);
``floor(scale * c)`` beyond 64 bits is the nearest number of 64 bits; a sum of squares
beyond 64 bits is null; components whose eigenvalue is zero, to double precision, have a
null ``whitened`` and take no part in ``identity_error``, which is null without any
other component; if all vectors are equal ``explained`` is null too; fewer dimensions than
components give as many components; an empty table, or one of empty vectors only, gives an empty
result; other columns are ignored. A task holds a block of rows and ``FAN`` factors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.cut import Scratch, cut

SCALE, COMPONENTS = 256, 4
#: Factors that one task merges.
FAN = 8
#: Numbers in a block of rows, if the block has twice as many rows as columns.
BLOCK = 1 << 20
_LARGE = 2**62


def to_integers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * c) of each entry, only of vectors without null or non-finite entries."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def same_length(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vectors`` with zeros after the shorter ones, and their length."""
    found = vectors.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    d = found.high or 0
    if found.low == found.high:
        return vectors, d
    return vectors.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))), d


def blocks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches and their vectors as rows of a matrix."""
    rows = max(2 * d, BLOCK // d)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            yield piece, piece.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: of 64 bits where all fit, else Python's integers."""
    largest = max((abs(int(x.min())), abs(int(x.max()))), default=0) if x.size else 0
    if n * largest + max(map(abs, sums)) < _LARGE:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def squares(c: np.ndarray) -> list[int | None]:
    """Exact sums of squares of the rows; None beyond 64 bits."""
    largest = max(abs(int(c.min())), abs(int(c.max()))) if c.size else 0
    if largest**2 * c.shape[1] < _LARGE:
        return (c.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in (sum(int(v) ** 2 for v in row) for row in c)]


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and the sum of each dimension; halves of 32 bits are summed, so that none overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, dtype=object), np.zeros(d, dtype=object)
        for _, x in blocks(batches, 0, d):
            n += len(x)
            high += (x >> 32).sum(axis=0).astype(object)
            low += (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        if n:
            out = [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([int(v) for v in high], pa.int64()), pa.array([int(v) for v in low], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["dim", "n", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = vectors.select("x").mapInArrow(run, "dim int, n bigint, high bigint, low bigint").groupBy("dim").agg(F.sum("n").alias("n"), *wide).collect()  # a row a dimension
    rows.sort()
    return rows[0].n, [(int(r.high) << 32) + int(r.low) for r in rows]


def triangle(parts: list[np.ndarray]) -> np.ndarray:
    """The R factor of matrices above each other."""
    return np.linalg.qr(np.vstack(parts), mode="r")


def last_factor(vectors: DataFrame, d: int, n: int, sums: list[int], scratch: Scratch) -> np.ndarray:
    """R of all centred rows: a factor of each partition, then ``FAN`` to one until one is left."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, d))
        for _, x in blocks(batches, 0, d):
            r = triangle([r, (centred(x, n, sums) / n).astype(float)])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["node", "r"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node": frame["node"].iloc[:1] // FAN, "r": [triangle([np.frombuffer(r).reshape(-1, d) for r in frame.sort_values("node")["r"]]).tobytes()]})

    kind = "node bigint, r binary"
    factors = scratch.table(vectors.select("x").mapInArrow(first, kind))
    while factors.agg(F.count("*")).first()[0] > 1:
        factors = scratch.table(factors.groupBy(F.floor(F.col("node") / FAN)).applyInPandas(merge, kind))
    return np.frombuffer(factors.first().r).reshape(-1, d)


class Whitening:
    """n, sums, eigenvalues and components of a fit list; ``transform`` whitens integer vectors."""

    def __init__(self, n: int, sums: list[int], factor: np.ndarray, components: int = COMPONENTS):
        _, s, right = np.linalg.svd(factor, full_matrices=True)
        self.n, self.sums, self.d = n, sums, len(sums)
        values = np.zeros(self.d)
        values[: len(s)] = s**2 / n
        self.trace = float(values.sum())
        k = min(components, self.d)
        self.values, self.vectors = values[:k], right[:k].T
        zero = s.max(initial=0.0) * max(factor.shape) * np.finfo(float).eps
        self.live = np.sqrt(self.values * n) > zero
        with np.errstate(divide="ignore", invalid="ignore"):
            self.weights = np.where(self.live, self.vectors / np.sqrt(self.values), np.nan)
        self.explained = [float(v / self.trace) if self.trace > 0 else None for v in self.values]
        self.identity_error: float | None = None

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n*x - S and the whitened rows; NaN for components without extent."""
        c = centred(x, self.n, self.sums)
        return c, (c / self.n).astype(float) @ self.weights

    def measure(self, vectors: DataFrame) -> float | None:
        """The largest absolute entry of the whitened fit list's covariance minus the identity."""
        model, k = self, int(self.live.sum())
        if not k:
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k))
            for _, x in blocks(batches, 0, model.d):
                w = model.project(x)[1][:, model.live]
                total += np.vstack([w.sum(axis=0), w.T @ w])
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(v.ravel(), t) for v, t in ((i, pa.int32()), (j, pa.int32()), (total, pa.float64()))], ["i", "j", "v"])

        sums = np.zeros((k + 1, k))
        for r in vectors.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # (k + 1) * k rows
            sums[r.i, r.j] = r.v
        mean = sums[0] / self.n
        return float(np.abs(sums[1:] / self.n - np.outer(mean, mean) - np.eye(k)).max())

    def transform(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
        kind = next(f for f in vectors.schema.fields if f.name == "vec_id").dataType.simpleString()
        model, k = self, len(self.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece, x in blocks(batches, 1, model.d):
                c, w = model.project(x)
                m = len(x)
                columns = [
                    piece.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n), pa.int64()),
                    pa.array([v for v in squares(c) for _ in range(k)], pa.int64()),
                    pa.array(w.ravel(), pa.float64(), mask=np.isnan(w).ravel()),
                    pa.array(model.explained * m, pa.float64()),
                    pa.array([model.identity_error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def fit(vectors: DataFrame, d: int, components: int, scratch: Scratch) -> Whitening:
    """The whitening of the distinct ``vectors`` (x of ``d`` longs), with its measured error."""
    distinct = scratch.table(vectors.select("x").distinct())
    n, sums = exact_sums(distinct, d)
    model = Whitening(n, sums, last_factor(distinct, d, n, sums, scratch), components)
    model.identity_error = model.measure(distinct)
    return model


def whiten(embeddings: DataFrame, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """Every vector of finite entries, whitened; see ``Whitening.transform``."""
    with Scratch(embeddings.sparkSession) as scratch:
        vectors = scratch.table(to_integers(embeddings, scale))
        vectors, d = same_length(vectors)
        if not d:
            kind = vectors.schema["vec_id"].dataType.simpleString()
            return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
        return cut(fit(vectors, d, components, scratch).transform(vectors))
