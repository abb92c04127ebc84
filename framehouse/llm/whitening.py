"""Embedding whitening: a distributed centred scatter, cyclic Jacobi on the driver, the whitening matrix broadcast.

Entries become whole numbers x = floor(1024 c) + 100000, so that sums are exact. Tasks add up the scatter of x less the
rounded mean, whose products are small whole numbers (exact in doubles below 2**53), and what the rounding left of the
mean is taken off at the end. Jacobi rotations go through all pairs of dimensions again and again until every
off-diagonal entry vanishes beside its two diagonal ones, which keeps small eigenvalues accurate. Only arrays of the size
of the covariance reach the driver, as many as the root of the number of partitions.

Defined results: vectors that are null, empty, or hold null or non-finite entries are left out, as are those with an entry
of 2**20 or more in magnitude and those of another than the most frequent length (of equally frequent ones the longest is
taken). Rows with a null or repeated vec_id each count. A component whose eigenvalue is zero within rounding has no
whitened values (null), and identity_error is that of the other components (null if there are none). A deviation that
exceeds a long is null. Fewer dimensions than components give as many components as dimensions. An empty table gives no
rows. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framehouse.llm.vectors import commonest_size, tree_sum, usable, whole

COMPONENTS, OFFSET, LARGEST, SWEEPS = 8, 100_000, 2.0**20, 60
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: np.ndarray  # of x, by dimension, whole
    values: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # unit eigenvectors, one a column
    trace: float

    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))

    def matrix(self, components: int) -> np.ndarray:
        """dimension x components: eigenvectors over the roots of their eigenvalues; not a number where one is zero."""
        e = self.values[:components].copy()
        e[e <= len(self.values) * np.finfo(float).eps * self.trace] = np.nan
        return self.vectors[:, :components] / np.sqrt(e)

    def centred(self, x: np.ndarray) -> np.ndarray:
        near, rest = rounded_mean(self.n, self.sums)
        return (x - near) - rest / self.n


def rounded_mean(n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded mean of each dimension, and what is left of its sum."""
    near = (2 * sums + n) // (2 * n)
    return near, sums - n * near


def jacobi(matrix: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by cyclic rotations."""
    a, d = np.array(matrix, float), len(matrix)
    v, eps = np.eye(d), np.finfo(float).eps
    floor = eps * eps * np.abs(a).max(initial=0)
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= floor or abs(off) <= eps * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                diag = a[p, p] - t * off, a[q, q] + t * off
                row_p, row_q = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[q] = row_p, row_q
                a[:, p], a[:, q] = row_p, row_q
                a[p, p], a[q, q] = diag
                a[p, q] = a[q, p] = 0.0
                v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order] / np.sqrt((v[:, order] ** 2).sum(0))


def coded(batches: Iterator[pa.RecordBatch], d: int, column: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield whole(batch.column(column), d) + OFFSET


def kept(vectors: DataFrame) -> tuple[DataFrame, int | None]:
    """vec_id and embedding of the rows that take part, and their dimension (None without rows)."""
    rows = vectors.where(usable(vectors, "embedding", LARGEST)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    d = commonest_size(rows, "embedding")
    return (rows if d is None else rows.where(F.size("embedding") == d)), d


def fit(rows: DataFrame, d: int) -> Whitening:
    """Of kept rows: exact sums in one pass, the centred scatter in another."""

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros(d + 1, np.int64)
        for x in coded(batches, d):
            total += np.append(x.sum(0), len(x))
        return total if total[d] else None

    found = tree_sum(rows.select("embedding"), add, "<i8")
    n, sums = int(found[d]), found[:d]
    near, rest = rounded_mean(n, sums)

    def scatter(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total, some = np.zeros((d, d)), False
        for x in coded(batches, d):
            y = (x - near).astype(float)
            total += y.T @ y
            some = True
        return total if some else None

    products = tree_sum(rows.select("embedding"), scatter, "<f8").reshape(d, d)
    rest = rest.astype(float)
    covariance = (products - np.outer(rest, rest / n)) / n
    values, axes = jacobi((covariance + covariance.T) / 2)
    return Whitening(n, sums, values, axes, float(np.trace(covariance)))


def identity_error(rows: DataFrame, model: Whitening, components: int) -> float | None:
    """The largest absolute entry of (covariance of the whitened values - identity), measured over all rows."""
    matrix = model.matrix(components)
    matrix = matrix[:, ~np.isnan(matrix[0])]
    k, d = matrix.shape[1], len(model.sums)
    if not k:
        return None
    shared = rows.sparkSession.sparkContext.broadcast((model, matrix))

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        model, matrix = shared.value
        total, some = np.zeros((k + 1, k)), False
        for x in coded(batches, d):
            z = model.centred(x) @ matrix
            total[:k] += z.T @ z
            total[k] += z.sum(0)
            some = True
        return total if some else None

    total = tree_sum(rows.select("embedding"), moments, "<f8").reshape(k + 1, k)
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - sums)**2, exact; None where it exceeds a long."""
    most = max(int(np.abs(x).max()) * n, int(np.abs(sums).max()))
    if len(sums) * (2 * most) ** 2 < 2**63:
        return ((n * x - sums) ** 2).sum(1).tolist()
    big = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [b if b < 2**63 else None for b in big]


def project(rows: DataFrame, model: Whitening, components: int) -> DataFrame:
    """vec_id, component, n, deviation, whitened: a row for each kept row and component."""
    d, matrix = len(model.sums), model.matrix(components)
    k = matrix.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((model, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, matrix = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = whole(part.column(1), d) + OFFSET
                z = (model.centred(x) @ matrix).ravel()
                which = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [part.column(0).take(which), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(z), model.n)), pa.array(deviations(x, model.n, model.sums), pa.int64()).take(which), pa.array(z, mask=np.isnan(z))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every kept row and component."""
    rows, d = kept(vectors)
    if d is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    model = fit(rows, d)
    share = model.explained()[:components].tolist()
    return project(rows, model, components).select(
        "vec_id", "component", "n", "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, share)), F.col("component")).alias("explained"),
        F.lit(identity_error(rows, model, components)).cast("double").alias("identity_error"))
