"""Many KMeans runs at once: all restarts, and all numbers of clusters, advance in one scan per iteration.

Every run keeps its own centres. A pass ships the centres of all runs that still move; each task multiplies its
batches with all of them at once, and hands out the sums, sizes and costs of all clusters as one array, which
are added in a tree of tasks (``functions/sums``). So r restarts take as many scans as the slowest of them and
not the sum of all. A run ends when no centre moves by more than ``tol``; its cost is measured in the pass after
that. An empty cluster keeps its centre; on equal distance the lower cluster number counts.

Starts are drawn by k-means++ from at most ``SAMPLE`` rows (those with the smallest hashes), a bounded sample
that only decides where the iterations begin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.functions.sums import summed

SAMPLE = 20_000
ROWS = 4096


@dataclass(frozen=True)
class KMeansRun:
    """Centres in order of their coordinates, the cost of assigning every row to the nearest, and the passes taken."""

    centres: np.ndarray
    cost: float
    passes: int

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)


def start_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: every next centre is drawn by its squared distance to those before."""
    chosen = [sample[rng.integers(len(sample))]]
    far = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = far.sum()
        at = rng.choice(len(sample), p=far / total) if total > 0 else rng.integers(len(sample))
        chosen.append(sample[at])
        far = np.minimum(far, ((sample - sample[at]) ** 2).sum(axis=1))
    return np.array(chosen)


def sums_of(x: np.ndarray, centres: list[np.ndarray]) -> np.ndarray:
    """For the clusters of all runs one after the other: sums per dimension, size and cost."""
    d = x.shape[1]
    every = np.concatenate(centres)
    out = np.zeros((len(every), d + 2))
    for a in range(0, len(x), ROWS):
        rows = x[a : a + ROWS]
        cross, begin = (every * every).sum(axis=1) - 2.0 * rows @ every.T, 0
        for c in centres:
            own = cross[:, begin : begin + len(c)]
            label = own.argmin(axis=1)
            near = ((rows - c[label]) ** 2).sum(axis=1)
            for j in range(d):
                out[begin : begin + len(c), j] += np.bincount(label, rows[:, j], len(c))
            out[begin : begin + len(c), d] += np.bincount(label, minlength=len(c))
            out[begin : begin + len(c), d + 1] += np.bincount(label, near, len(c))
            begin += len(c)
    return out


def iterate(rows: DataFrame, starts: Sequence[np.ndarray], max_iter: int = 300, tol: float = 1e-4) -> list[KMeansRun]:
    """Lloyd's iterations of all runs over ``rows`` (column x, an array of doubles), one scan per pass for all."""
    spark = rows.sparkSession
    centres, passes = [np.array(s, float) for s in starts], [0] * len(starts)
    found: list[KMeansRun | None] = [None] * len(starts)
    still = set(range(len(starts)))  # runs whose centres still move; the others only need their cost
    parts = max(1, rows.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    while open_ := [r for r, run in enumerate(found) if run is None]:
        shared = spark.sparkContext.broadcast([centres[r] for r in open_])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
                    got = sums_of(x, shared.value)
                    total = got if total is None else total + got
            if total is not None:
                yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

        d = centres[open_[0]].shape[1]
        total = summed(rows.mapInArrow(run, "part int, sums binary"), parts, [], float).get((), np.zeros(0)).reshape(-1, d + 2)
        shared.unpersist()
        begin = 0
        for r in open_:
            own = total[begin : begin + len(centres[r])]
            begin += len(centres[r])
            if r not in still:
                order = np.lexsort(centres[r].T[::-1])
                found[r] = KMeansRun(centres[r][order], float(own[:, d + 1].sum()), passes[r])
                continue
            passes[r] += 1
            size = own[:, d : d + 1]
            new = np.where(size > 0, own[:, :d] / np.maximum(size, 1), centres[r])
            moved = np.sqrt(((new - centres[r]) ** 2).sum(axis=1).max(initial=0.0))
            centres[r] = new
            if moved <= tol or passes[r] >= max_iter:
                still.discard(r)
    return found


def fit(vectors: DataFrame, column: str, ks: Sequence[int], restarts: int, seed: int, max_iter: int = 300, tol: float = 1e-4) -> dict[int, list[KMeansRun]]:
    """``restarts`` runs for each number of clusters in ``ks``, all in the same passes."""
    x = vectors.select(F.col(column).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sample = np.array([r["x"] for r in x.orderBy(F.xxhash64("x"), "x").limit(SAMPLE).collect()], float)
        if not len(sample):
            return {k: [] for k in ks}
        wanted = [(k, i) for k in ks for i in range(restarts)]
        runs = iterate(x, [start_centres(sample, k, np.random.default_rng([seed, k, i])) for k, i in wanted], max_iter, tol)
    finally:
        x.unpersist()
    return {k: [run for (kk, _), run in zip(wanted, runs) if kk == k] for k in ks}


def best(runs: Sequence[KMeansRun]) -> KMeansRun:
    """The run of least cost; the first of equal ones."""
    return min(runs, key=lambda r: r.cost)
