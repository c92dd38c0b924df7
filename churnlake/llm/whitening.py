"""Whitening of embeddings by the exact eigenvalues of their integer scatter.

Entries become integers x = floor(64 * c) (the contract's + 1000000 moves every x alike and is left out where
nothing depends on it). The fit list, every distinct x vector once, is a written table of packed vectors. Its
counts, sums and products are exact integers, summed in tasks and then by entry in Spark; only the d x d result
comes to the driver. n * sum(x x') - S S' is n^2 times the covariance; ``charpoly`` takes its eigenvalues from
its characteristic polynomial, whose residues are computed by Spark tasks. Rows are projected in one pass.

Rows whose vector is null, or holds nulls or values that are not finite, are dropped. So are rows of another
length than most rows have (of equally frequent lengths the larger one counts): they have no place in a common
covariance. Zero vectors stay. Entries with |64 c| beyond 2^53 count as 2^53. Repeated rows are all returned; a
null vec_id stays null. Components of eigenvalue 0 do not exist: a table whose vectors are all equal, or an
empty one, gives no rows. A deviation beyond 64 bits is null. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.llm import charpoly
from churnlake.llm.common import cut

SCALE = 64
LIMIT = float(1 << 53)
ROWS = 2048


def usable(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of the rows that take part, and the length of their vectors."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).filter(F.coalesce(finite, F.lit(False)) & (F.size("v") > 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return rows.filter(F.size("v") == d), d


def integers(column: pa.Array, d: int) -> np.ndarray:
    """floor(64 * c) of a column of vectors, one row each."""
    values = np.asarray(column.flatten(), np.float64).reshape(-1, d)
    return np.floor(np.clip(values, -LIMIT / SCALE, LIMIT / SCALE) * SCALE).astype(np.int64)


def _packed(x: np.ndarray) -> pa.Array:
    """Each vector as bytes: 16 bits an entry where all entries fit, else 64."""
    narrow = ((x >= -(1 << 15)) & (x < 1 << 15)).all(axis=1)
    if narrow.all():
        size = 2 * x.shape[1]
        data = np.ascontiguousarray(x.astype("<i2"))
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * size), pa.py_buffer(data)])
    return pa.array([row.astype("<i2" if short else "<i8").tobytes() for row, short in zip(x, narrow)], pa.binary())


def _unpacked(column: pa.Array, d: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<i2" if len(b) == 2 * d else "<i8").astype(np.int64) for b in column.to_pylist()])


def fit_list(rows: DataFrame, d: int) -> DataFrame:
    """(x binary): every distinct integer vector once, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([_packed(integers(batch.column(0), d))], ["x"])

    return cut(rows.select("v").mapInArrow(run, "x binary").distinct(), "fit_list")


def _products(x: np.ndarray) -> np.ndarray:
    """x' x, exact: by doubles where they hold every sum, else by whole numbers of any size."""
    peak = int(np.abs(x).max(initial=0))
    if peak * peak * len(x) < 1 << 53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    big = x.astype(object)
    return big.T @ big


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, their sums per dimension and n * sum(x x') - S S', all exact."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                x = _unpacked(batch.column(0).slice(a, ROWS), d)
                n += len(x)
                sums += x.sum(axis=0).astype(object)
                squares += _products(x)
        if n:
            i = [-1, *[-1] * d, *upper[0].tolist()]
            j = [-1, *range(d), *upper[1].tolist()]
            v = [n, *sums.tolist(), *squares[upper].tolist()]
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(s)) for s in v], pa.decimal128(38, 0))], ["i", "j", "s"])

    rows = fit.mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    of = {(r["i"], r["j"]): int(r["s"]) for r in rows}
    if not of:
        return 0, [], []
    n, sums = of[-1, -1], [of[-1, j] for j in range(d)]
    return n, sums, [[n * of[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


class Whitener:
    """What a fit leaves: n, sums, weights (d x components), shares of the variance and the measured error."""

    def __init__(self, n: int, sums: list[int], weights: np.ndarray, explained: list[float]):
        self.n, self.sums, self.weights, self.explained = n, sums, weights, explained
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as exact integers, of 64 bits where sums of their squares fit."""
        peak = self.n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in self.sums)
        if x.shape[1] * peak * peak < 1 << 63:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.weights


def fit(rows: DataFrame, d: int, components: int = 16) -> Whitener | None:
    """The whitening of the distinct vectors of ``rows``; None if they do not vary."""
    listed = fit_list(rows, d)
    n, sums, matrix = scatter(listed, d)
    found = charpoly.largest(rows.sparkSession, matrix, components) if n else []
    if not found:
        return None
    trace = sum(matrix[i][i] for i in range(d))
    deviations = [(a / (n * n << bits)) ** 0.5 for (a, bits), _ in found]
    weights = np.array([v for _, v in found]).T / np.array(deviations)
    model = Whitener(n, sums, weights, [a / (trace << bits) for (a, bits), _ in found])
    k = len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                y = model.whitened(model.centred(_unpacked(batch.column(0).slice(a, ROWS), d)))
                total += y.T @ y
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.reshape(-1))], ["i", "j", "s"])

    sums_ = listed.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    model.identity_error = max(abs(r["s"] / n - (r["i"] == r["j"])) for r in sums_)
    return model


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 16) -> DataFrame:
    """One row per remaining row of ``vectors`` and component; see ``SCHEMA`` and the module's text."""
    spark = vectors.sparkSession
    rows, d = usable(vectors, column)
    model = fit(rows, d, components) if d else None
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.explained)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                size = part.num_rows
                centred = m.centred(integers(part.column(1), d))
                squares = (centred * centred).sum(axis=1)
                if squares.dtype == object:
                    squares = [s if s < 1 << 63 else None for s in squares.tolist()]
                at = pa.array(np.repeat(np.arange(size), k))
                yield pa.record_batch(
                    [
                        part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, m.n, np.int64)),
                        pa.array(squares, pa.int64()).take(at), pa.array(m.whitened(centred).reshape(-1)), pa.array(np.tile(m.explained, size)),
                        pa.array(np.full(size * k, m.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, SCHEMA)
