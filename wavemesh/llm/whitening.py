"""Embedding whitening by a tall-skinny QR decomposition.

Entries become integers, x = floor(64 c) + 1000000. The vectors that are fitted on are the distinct ones of these. Their
count n and sums S are exact, so a centred row is (n x - S) / n, rounded once. Every task takes the R factor of its centred
rows, batch after batch; R factors are merged over a tree of tasks until one is left, whose singular value decomposition
has the components as right vectors and n times the variances as squares: no covariance is formed. All rows are then
projected. That the result is white is measured over the fitted vectors: every task centres its whitened rows before it
multiplies them, and the tasks' moments are merged over the same kind of tree.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries or ones of 2^55 and more are dropped;
vectors of each number of dimensions are fitted by themselves; components without variance (a singular value below 1e-10
of the largest) can't be whitened and have no row, so a single distinct vector gives none; a deviation that a long can't
hold is null; rows that repeat, or share a vec_id, are returned each, and a null vec_id stays null; ties between equal
variances are broken by the decomposition, the same for all rows; no rows give no rows; other columns are ignored.
A task holds a batch of rows and a square matrix of the dimensions, the driver the last such matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import merged, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries of this size and more have no x; singular values below this share of the largest count as none.
LARGEST, NO_VARIANCE = 2.0**55, 1e-10
ROWS = 4096

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


@dataclass(frozen=True)
class Fit:
    """n distinct vectors of sums S; components as columns, unit vectors by falling variance, and all variances' sum."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.components / np.sqrt(self.variances))


def scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: as 64-bit integers where they fit, or else as Python's."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (scaled(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    d = scaled(x, n, sums)
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2**63:
        return (d * d).sum(1).tolist()
    return [s if s < 2**63 else None for s in (d.astype(object) ** 2).sum(1).tolist()]


def _blocks(batches: Iterator[pa.RecordBatch], size: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, len(whole), ROWS):
            b = whole.slice(at, ROWS)
            yield b, b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """The rows of fit (x) and their sums by dimension, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for _, x in _blocks(batches, size):
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    total = fit.select("x").mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    rows = sorted(total.collect())  # a row per dimension
    return rows[0].n, [(int(r.high) << 32) + int(r.low) for r in rows]


def _r_factor(fit: DataFrame, size: int, n: int, sums: list[int]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, size))
        for _, x in _blocks(batches, size):
            r = np.linalg.qr(np.vstack((r, centred(x, n, sums))), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["id", "blob"])

    def merge(blobs: list[bytes]) -> bytes:
        return np.linalg.qr(np.vstack([np.frombuffer(b).reshape(-1, size) for b in blobs]), mode="r").tobytes()

    return np.frombuffer(merged(fit.select("x").mapInArrow(run, "id int, blob binary"), merge)).reshape(-1, size)


def fitted(fit: DataFrame, size: int, components: int = COMPONENTS) -> Fit:
    """The leading components of fit (x, distinct arrays of so many longs), one row at least."""
    n, sums = _sums(fit, size)
    _, s, right = np.linalg.svd(_r_factor(fit, size, n, sums), full_matrices=False)
    k = min(components, int((s > s[0] * NO_VARIANCE).sum()))
    right = right[:k] * np.where(right[np.arange(k), np.abs(right[:k]).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return Fit(n, sums, right.T, s[:k] ** 2 / n, float((s**2).sum() / n))


def identity_error(fit: DataFrame, size: int, model: Fit) -> float:
    """The largest absolute entry of the covariance of fit's whitened rows, less the identity."""
    k = model.components.shape[1]

    def joined(a: tuple, b: tuple) -> tuple:
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)

    def packed(m: tuple) -> bytes:
        return np.concatenate(([float(m[0])], m[1], m[2].ravel())).tobytes()

    def unpacked(blob: bytes) -> tuple:
        f = np.frombuffer(blob)
        return f[0], f[1 : k + 1], f[k + 1 :].reshape(k, k)

    def all_of(parts: list[tuple]) -> tuple:
        total = parts[0]
        for p in parts[1:]:
            total = joined(total, p)
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for _, x in _blocks(batches, size):
            w = model.whitened(x)
            mean = w.mean(0)
            parts = [all_of([*parts, (len(w), mean, (w - mean).T @ (w - mean))])]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([packed(parts[0])], pa.binary())], names=["id", "blob"])

    n, _, products = unpacked(merged(fit.select("x").mapInArrow(run, "id int, blob binary"), lambda blobs: packed(all_of([unpacked(b) for b in blobs]))))
    return float(np.abs(products / n - np.eye(k)).max())


def projected(rows: DataFrame, size: int, model: Fit) -> DataFrame:
    """OUT: a row for each of rows (vec_id, x) and component."""
    k, share = model.components.shape[1], model.variances / model.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches, size, 1):
            rows = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [b.column(0), pa.array(deviations(x, model.n, model.sums), pa.int64())]
            ids, deviation = (c.take(rows) for c in columns)
            repeated = lambda v, kind: pa.array(np.tile(v, len(x)), kind)
            yield pa.RecordBatch.from_arrays([ids, repeated(np.arange(1, k + 1, dtype=np.int32), pa.int32()), pa.array(np.full(len(rows), model.n), pa.int64()), deviation, pa.array(model.whitened(x).ravel()), repeated(share, pa.float64())], names=[c.split()[0] for c in OUT.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(run, OUT)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors: vec_id, embedding. Returns OUT and identity_error, a row for each usable vector and component."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = f"vector IS NOT NULL AND size(vector) > 0 AND forall(vector, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < {LARGEST!r}D)"
    good = rows.where(fine).select("vec_id", F.size("vector").alias("size"), F.transform("vector", lambda c: F.floor(c * float(SCALE)).cast("long") + SHIFT).alias("x"))
    good = stored(good, "whiten-rows")
    fit = stored(good.select("size", "x").distinct(), "whiten-fit")
    out = good.sparkSession.createDataFrame([], OUT + ", identity_error double")
    for (size,) in fit.select("size").distinct().orderBy("size").collect():
        own = fit.where(F.col("size") == size)
        model = fitted(own, size, components)
        if model.components.shape[1]:
            out = out.unionByName(projected(good.where(F.col("size") == size), size, model).withColumn("identity_error", F.lit(identity_error(own, size, model))))
    return out
