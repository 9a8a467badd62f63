"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Entries become whole numbers first, so sums over any number of rows are exact. The fit list holds each distinct vector
once; it is written once and read three times, for sums, for the scatter and for the check of the result. Each task
adds up its own share and sends one number per cell of the triangle, so what is shuffled and what the driver sees is
bounded by the square of the number of dimensions and the number of tasks, never by rows.

With V = G G', rotating pairs of columns of G until all are orthogonal gives G J = U D: the norms of the columns are
square roots of eigenvalues and the normalised columns are the components. The factor is triangular up to the pivots, and
pivoting sorts its columns so that few sweeps are needed; V is never squared and small eigenvalues keep their digits.

Defined results: rows whose vector is null or holds a null or non-finite entry have no result. The space is that of the
length most rows have (ties: the greater length); rows of other lengths, empty vectors too, have no result. Entries are limited
to 2^60 in size after scaling. Repeated rows are rows of their own with one vector in the fit list; a null id stays null.
Components of eigenvalue zero do not exist, so a table of one distinct vector, or none, gives no rows. A deviation
beyond a long is null. Equal eigenvalues: any orthonormal basis of their space. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import Scratch

SCALE, COMPONENTS, LIMIT = 256, 4, 1 << 60
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def finite(vector: Column) -> Column:
    """The vector is there and holds only finite numbers."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * entry) of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(scale)) * c))))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an Arrow column of lists of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def exact(values: np.ndarray, most: int) -> np.ndarray:
    """The values as Python integers where `most`, a bound of what is done with them, goes beyond a long."""
    return values if most < 1 << 62 else values.astype(object)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """G with G G' = v for a positive semidefinite v; as many columns as its numerical rank, largest pivots first."""
    d = len(v)
    rest, factor = v.diagonal().copy(), np.zeros((d, d))
    floor = d * np.finfo(float).eps * max(float(rest.max(initial=0)), 0.0)
    for k in range(d):
        p = int(np.argmax(rest))
        if rest[p] <= floor:
            return factor[:, :k]
        factor[:, k] = (v[:, p] - factor[:, :k] @ factor[p, :k]) / math.sqrt(rest[p])
        rest -= factor[:, k] ** 2
        rest[p] = -np.inf
    return factor


def _rounds(k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of k columns as rounds of disjoint pairs, each round done at once."""
    ring = list(range(k + k % 2))
    found = []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :]), strict=True) if max(a, b) < k]
        found.append((np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return found


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of factor @ factor.T, by falling eigenvalue."""
    g, k = factor.copy(), factor.shape[1]
    plan = _rounds(k) if k > 1 else []
    for _ in range(sweeps):
        worst = 0.0
        for i, j in plan:
            x, y = g[:, i], g[:, j]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, float(off.max(initial=0)))
            turn = off > 1e-15
            zeta = np.where(turn, (b - a) / np.where(turn, 2 * c, 1), 0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0)
            cosine = 1 / np.hypot(1.0, t)
            sine = cosine * t
            g[:, i], g[:, j] = cosine * x - sine * y, sine * x + cosine * y
        if worst <= 1e-14:
            break
    norms = np.sqrt((g * g).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, g[:, order] / norms[order]


@dataclass
class Whitening:
    """A fitted transform: count and sums of the fit list, eigenvalues, components as columns, trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean is taken off before anything is rounded."""
        base = np.array([s // self.n for s in self.sums], object)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        most = int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) // self.n + 1
        away = x - base.astype(np.int64) if most < 1 << 62 else (x.astype(object) - base)
        return away.astype(np.float64) - rest

    def whitened(self, x: np.ndarray, count: int) -> np.ndarray:
        return self.centred(x) @ self.components[:, :count] / np.sqrt(self.values[:count])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly."""
        top = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        wide = exact(x, len(self.sums) * top * top)
        away = wide * self.n - np.array(self.sums, wide.dtype)
        return [v if v < 1 << 63 else None for v in (away * away).sum(axis=1).tolist()]


def _sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total, n = [0] * width, 0
    for batch in batches:
        x = matrix(batch.column(0), width)
        x = exact(x, len(x) * int(np.abs(x).max(initial=0)))
        total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)] if len(x) else total
        n += len(x)
    if n:
        cells = pa.array([Decimal(v) for v in [*total, n]], pa.decimal128(38, 0))
        yield pa.record_batch([pa.array(range(width + 1), pa.int32()), cells], names=["cell", "v"])


def _products(batches: Iterator[pa.RecordBatch], width: int, rows_of) -> Iterator[pa.RecordBatch]:
    """One row for each cell of the upper triangle of the sum of outer products of rows_of(x)."""
    total = None
    for batch in batches:
        y = rows_of(matrix(batch.column(0), width))
        total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])


def covariance(fit: DataFrame, n: int, width: int, size: int, rows_of) -> np.ndarray:
    """Mean of the outer products of rows_of(x), which centres; size x size."""
    cells = fit.select("x").mapInArrow(lambda it: _products(it, width, rows_of), "i int, j int, v double")
    found = np.zeros((size, size))
    for i, j, v in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        found[i, j] = found[j, i] = v / n
    return found


def fit_whitening(fit: DataFrame, width: int) -> Whitening | None:
    """Learn from the distinct vectors `x` of a table; None where there are none."""
    cells = fit.select("x").mapInArrow(lambda it: _sums(it, width), "cell int, v decimal(38,0)").groupBy("cell").agg(F.sum("v").alias("v"))
    found = {r.cell: int(r.v) for r in cells.collect()}
    if not found:
        return None
    model = Whitening(found[width], [found[i] for i in range(width)], np.zeros(0), np.zeros((width, 0)), 0.0)
    v = covariance(fit, model.n, width, width, model.centred)
    model.values, model.components = one_sided_jacobi(pivoted_cholesky(v))
    model.trace = float(np.trace(v))
    return model


def _apply(batches: Iterator[pa.RecordBatch], model: Whitening, count: int, error: float) -> Iterator[pa.RecordBatch]:
    share = np.minimum(model.values[:count] / model.trace, 1.0)
    for batch in batches:
        if not batch.num_rows:
            continue
        x, rows = matrix(batch.column(1), len(model.sums)), batch.num_rows
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(rows), count)))
        far = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), count)))
        yield pa.record_batch(
            [ids, pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)), pa.array(np.full(rows * count, model.n)), far,
             pa.array(model.whitened(x, count).ravel()), pa.array(np.tile(share, rows)), pa.array(np.full(rows * count, error))],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """RESULT for every usable row of (vec_id, embedding) and each of the first components."""
    spark = rows.sparkSession
    held = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    held = held.where(finite(F.col("e"))).select("vec_id", whole(F.col("e"), scale).alias("x"))
    lengths = held.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    if most is None or not most.width:
        return spark.createDataFrame([], RESULT)
    held = held.where(F.size("x") == most.width)
    fit = Scratch(spark, "whitening").keep(held.select("x").distinct(), "fit")
    model = fit_whitening(fit, most.width)
    count = min(components, len(model.values))
    if not count:
        return spark.createDataFrame([], RESULT)
    error = covariance(fit, model.n, most.width, count, lambda x: model.whitened(x, count)) - np.eye(count)
    worst = float(np.abs(error).max())
    return held.mapInArrow(lambda it: _apply(it, model, count, worst), RESULT)


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
