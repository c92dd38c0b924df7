"""Nearest neighbours by collision counting over single-projection sorted arrays.

``PROJECTIONS`` random projections are drawn once per dimension. A block of at most ``BLOCK`` vectors is indexed
inside a task by one sorted array per projection. A query's window in each array is centred on its own
projection and has half-width HALF * R; raising R is the virtual rehashing, and only the strips that a window
gains are read; where windows hold more than a ``WIDE``-th of the block, all its ranks are compared with the windows
at once, which counts the same. A vector collides as often as windows hold it. One at distance R or less is in each window with
a probability of at least erf(HALF / sqrt(2)), so it reaches ``least_collisions()`` with a probability of at
least 1 - MISS, whatever the data. Vectors that reach it are verified by their distance on the original
entries. A search ends when ``k`` verified vectors lie within R; there is no cap on candidates.

All rows are indexed. A pilot of at most ``PILOT`` vectors (those with the smallest hashes of their ids) gives
every query an upper bound of its k-th distance first; with it, each task indexes its blocks of all rows and
expands windows up to that bound only. Queries reach the tasks in chunks of about ``CHUNK`` rows, one pass over
the vectors a chunk: vectors are never shuffled, and nothing larger than a chunk or the pilot is broadcast.

Vectors that are null, zero, or hold nulls or values that are not finite take no part, nor do rows without
vec_id. Vectors are compared with vectors of their own length only. A query's own row is every row with its
vec_id; if rows of different vectors share a query's vec_id, the smallest vector asks. Repeated candidates
each count, ties go to the smaller vec_id. A query with no candidate, and an empty table, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.llm.common import cut

PROJECTIONS = 128
HALF = 1.5
MISS = 0.01
BLOCK, PILOT, CHUNK = 8192, 8192, 16_384
#: Bound of a block's and a pilot's vectors as doubles; long vectors make both smaller.
BYTES = 32 << 20
GROWTH = 1.5
WIDE = 8


def least_collisions(m: int = PROJECTIONS, half: float = HALF, miss: float = MISS) -> int:
    """The largest count that a vector at distance R reaches with a probability of at least 1 - miss."""
    p, below, least = erf(half / sqrt(2)), 0.0, 0
    while (below := below + comb(m, least) * p**least * (1 - p) ** (m - least)) <= miss:
        least += 1
    return least


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull())
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def by_length(ids: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each length that a column holds."""
    lengths = np.asarray(column.value_lengths())
    for d in np.unique(lengths).tolist():
        pick = np.flatnonzero(lengths == d)
        part = column if len(pick) == len(lengths) else column.take(pa.array(pick))
        yield ids[pick], np.asarray(part.flatten(), np.float64).reshape(-1, d)


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.directions = np.random.default_rng([17, vectors.shape[1]]).normal(size=(vectors.shape[1], PROJECTIONS))
        seen = np.ascontiguousarray((vectors @ self.directions).T)
        self.order = np.argsort(seen, axis=1, kind="stable")
        self.values = np.take_along_axis(seen, self.order, axis=1)
        self.slack = 1e-9 * float(np.abs(seen).max(initial=0.0))
        self.squares = (vectors * vectors).sum(axis=1)
        self.ranks: np.ndarray | None = None

    def edges(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place inside and first place after each query's window; arrays of (queries, projections)."""
        a, b = np.empty(low.shape, np.int64), np.empty(low.shape, np.int64)
        for j in range(PROJECTIONS):
            a[:, j], b[:, j] = np.searchsorted(self.values[j], low[:, j]), np.searchsorted(self.values[j], high[:, j], "right")
        return a, b

    def start(self, at: np.ndarray, k: int) -> np.ndarray:
        """A first radius for each query: about k vectors lie in its windows."""
        places = self.edges(at, at)[0]
        last = len(self.ids) - 1
        low = np.take_along_axis(self.values, np.clip(places - k, 0, last).T, axis=1).T
        high = np.take_along_axis(self.values, np.clip(places + k, 0, last).T, axis=1).T
        return np.maximum(np.median(high - low, axis=1) / (2 * HALF), self.slack + 1e-300)

    def _nearest(self, new: np.ndarray, own: int, query: np.ndarray, bound: float, k: int, have: tuple = (np.zeros(0, np.int64), np.zeros(0))) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of vectors that were found before and of new ones, by their original entries."""
        new = new[self.ids[new] != own]
        # rough distances first; whatever may be among the k nearest by them is measured exactly
        whole = query @ query
        dots = (self.vectors @ query)[new] if 2 * len(new) > len(self.ids) else self.vectors[new] @ query
        rough = self.squares[new] - 2.0 * dots + whole
        most = min(bound, have[1][-1] if len(have[1]) == k else np.inf) ** 2
        if len(new) > k:
            most = min(most, float(np.partition(rough, k - 1)[k - 1]))
        new = new[rough <= most * (1 + 1e-9) + 1e-9 * (self.squares.max(initial=0.0) + whole)]
        ids = np.append(have[0], self.ids[new])
        far = np.append(have[1], np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1)))
        top = np.lexsort((ids, far))[:k]
        return ids[top], far[top]

    def _wide(self, low: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
        """Vectors that lie in at least ``least`` of one query's windows, from their ranks in all arrays."""
        if self.ranks is None:
            self.ranks = np.empty(self.order.shape, np.uint16)
            np.put_along_axis(self.ranks, self.order, np.arange(len(self.ids), dtype=np.uint16)[None, :], axis=1)
        # ranks below a window wrap around to large numbers
        inside = (self.ranks - low[:, None].astype(np.uint16)) < (high - low)[:, None].astype(np.uint16)
        return np.flatnonzero(inside.sum(axis=0, dtype=np.uint8) >= least)

    def search(self, owns: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and distances of up to k nearest vectors of the block within its bound, for every query."""
        at, n = queries @ self.directions, len(self.ids)
        bounded = np.isfinite(bounds)
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        active = np.arange(len(queries))
        asked = np.flatnonzero(bounded)
        reach = HALF * bounds[asked, None] + self.slack
        low, high = self.edges(at[asked] - reach, at[asked] + reach)
        wide = np.flatnonzero((high - low).mean(axis=1) * WIDE > n)
        for row in wide.tolist():
            q = int(asked[row])
            best[q] = self._nearest(self._wide(low[row], high[row], least), owns[q], queries[q], bounds[q], k)
        active = np.setdiff1d(active, asked[wide])
        radius = np.where(bounded, bounds / GROWTH**4, self.start(at, k)) if len(active) else bounds
        # counts and marks have lines for the queries that are searched from small radii only
        line = {q: i for i, q in enumerate(active.tolist())}
        counts, verified = np.zeros((len(active), n), np.uint8), np.zeros((len(active), n), bool)
        lows = highs = self.edges(at[active], at[active])[0]
        while len(active):
            reach = HALF * radius[active, None] + self.slack
            low, high = self.edges(at[active] - reach, at[active] + reach)
            left = []
            for row, q in enumerate(active.tolist()):
                count, seen = counts[line[q]], verified[line[q]]
                if (high[row] - low[row]).mean() * WIDE > n:
                    new = self._wide(low[row], high[row], least)
                else:
                    for order, a, b, c, d in zip(self.order, low[row].tolist(), lows[row].tolist(), highs[row].tolist(), high[row].tolist()):
                        if a < b:
                            count[order[a:b]] += 1
                        if c < d:
                            count[order[c:d]] += 1
                    new = np.flatnonzero(count >= least)
                new = new[~seen[new]]
                seen[new] = True
                best[q] = self._nearest(new, owns[q], queries[q], bounds[q], k, best[q])
                enough = len(best[q][0]) == k and best[q][1][-1] <= radius[q]
                if not enough and not (bounded[q] and radius[q] >= bounds[q]) and not seen.all():
                    left.append(row)
            lows, highs, active = low[left], high[left], active[left]
            radius[active] = np.where(bounded[active], np.minimum(radius[active] * GROWTH, bounds[active]), radius[active] * GROWTH**2)
        return [(i[f <= t * (1 + 1e-12)], f[f <= t * (1 + 1e-12)]) for (i, f), t in zip(best, bounds)]


Chunk = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _chunk(rows: list) -> Chunk:
    """Ids, vectors and bounds of collected queries, by length."""
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(len(r["v"]), []).append(r)
    return {d: (np.array([r["vec_id"] for r in rs], np.int64), np.array([r["v"] for r in rs], np.float64), np.array([r["bound"] for r in rs])) for d, rs in found.items()}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors in blocks of one length, full ones as long as rows last."""
    kept: dict[int, list] = {}
    for batch in batches:
        for ids, vectors in by_length(np.asarray(batch.column(0)), batch.column(1)):
            d = vectors.shape[1]
            size = max(1, min(BLOCK, BYTES // (8 * d)))
            for a in range(0, len(ids), size):
                have = kept.setdefault(d, [])
                have.append((ids[a : a + size], vectors[a : a + size]))
                if sum(len(i) for i, _ in have) >= size:
                    yield np.concatenate([i for i, _ in kept[d]]), np.concatenate([v for _, v in kept.pop(d)])
    for have in kept.values():
        yield np.concatenate([i for i, _ in have]), np.concatenate([v for _, v in have])


def _parts(n: int, size: int) -> Iterator[slice]:
    # counts of a part of the queries hold at most 8 MB
    step = max(1, (8 << 20) // max(1, size))
    return (slice(a, a + step) for a in range(0, n, step))


def bounds(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Adds to queries (vec_id, v) the k-th distance within the pilot; infinite where the pilot has fewer."""
    spark, least = rows.sparkSession, least_collisions()
    lengths = rows.agg(F.max(F.size("v"))).first()[0]
    size = max(1, min(PILOT, BYTES // (8 * lengths))) if lengths else 1
    sample = _chunk([{"vec_id": r["vec_id"], "v": r["v"], "bound": 0.0} for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).collect()])
    shared = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[int, Index] = {}
        for batch in batches:
            for ids, vectors in by_length(np.asarray(batch.column(0)), batch.column(1)):
                d = vectors.shape[1]
                far = np.full(len(ids), np.inf)
                if d in shared.value:
                    if d not in built:
                        built[d] = Index(*shared.value[d][:2])
                    for part in _parts(len(ids), len(built[d].ids)):
                        got = built[d].search(ids[part], vectors[part], far[part], k, least)
                        far[part] = [f[-1] if len(f) == k else np.inf for _, f in got]
                yield pa.record_batch([pa.array(ids), pa.array(list(vectors), pa.list_(pa.float64())), pa.array(far)], ["vec_id", "v", "bound"])

    return queries.mapInArrow(run, "vec_id long, v array<double>, bound double")


def found_by(rows: DataFrame, chunk: Chunk, k: int) -> DataFrame:
    """(query_id, vec_id, score): at most k rows a block for each query of the chunk."""
    shared, least = rows.sparkSession.sparkContext.broadcast(chunk), least_collisions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _blocks(batches):
            if vectors.shape[1] not in shared.value:
                continue
            index = Index(ids, vectors)
            owns, queries, limit = shared.value[vectors.shape[1]]
            for part in _parts(len(owns), len(ids)):
                got = index.search(owns[part], queries[part], limit[part], k, least)
                asked = np.repeat(owns[part], [len(i) for i, _ in got])
                yield pa.record_batch([pa.array(asked), pa.array(np.concatenate([i for i, _ in got])), pa.array(np.concatenate([f for _, f in got]))], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query, column: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for each row for which ``is_query`` (a condition on vec_id) holds."""
    rows = usable(vectors, column)
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = cut(bounds(queries, rows, k), "queries")
    chunks = max(1, -(-asked.count() // CHUNK))
    parts = []
    for c in range(chunks):
        chunk = _chunk(asked.filter(F.expr(f"pmod(xxhash64(vec_id), {chunks})") == c).collect())
        parts.append(cut(found_by(rows, chunk, k), "found"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
