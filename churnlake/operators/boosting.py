"""Trees on shared histograms, for several models at once: second-order gradient boosting (level- or leaf-wise),
and classification trees and forests.

Rows are binned once (``bin_rows``): thresholds halfway between quantiles (between all values of a feature that has
few), packed into blocks that also carry the label and one weight per fold. A weight of 0 leaves a row out, so k folds are k weight columns of
the same rows. Each pass of training sums, for every model, gradient, hessian and rows by leaf, feature and bin
of the leaves that are open: one Spark job for all models. The sums are shuffled by leaf and searched for the best split
where they are added up; the driver gets a line per leaf. Sums are whole numbers (gradients in units of 2^-shift), so
trees do not depend on how rows are dealt. Of a node that may only be split by some features only these are summed.

Trees grow best leaf first (``grow``): all leaves that could still be chosen are gathered in the same pass, and a
priority queue over their gains picks the splits, so a tree of 63 leaves takes as many passes as it is deep.
Without a cap on leaves the same order gives a level-wise tree. Margins are part of the blocks; every round
replaces them, and every ``CUT_ROUNDS`` rounds the blocks are written to the shared folder.

Trees of a forest do not depend on one another: ``TOGETHER`` of them grow together. With the labels' weights as
gradient and hessian, the gain is the decrease of the Gini impurity and a leaf is the weighted share of label 1.

Binned rows of at most ``LOCAL_CELLS`` bytes are shuffled whole to tasks instead, and each booster (or a group of at least
``GROUP`` trees of a forest) is one task that runs the same ``grow`` on them: a pass costs no job then. Boosters keep rows by
node, gather only the smaller of two sibling leaves (the other is their parent less it) and count features of few bins
together (``Joint``). Both ways give equal trees.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Generator, Iterator, Sequence
from copy import copy
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.session import scratch_path

MAX_BINS = 255
BLOCK_ROWS = 8192
BLOCKS_PER_PART = 8
LOCAL_CELLS = 256 << 20
CUT_ROUNDS = 25
MIN_GAIN = 1e-6
#: Trees of a forest that one local task grows at least, and that grow together over Spark.
GROUP = 8
TOGETHER = 32
#: Rows of a block that are summed at once; bins of the nodes that are searched together; bytes of sums that a job
#: shuffles at most (one tree may have more), bytes of histograms that a local task keeps per tree.
CHUNK_ROWS = 1 << 18
PACK_CELLS = 1 << 17
JOB_BYTES = 1 << 30
KEPT_BYTES = 64 << 20
#: Rows of a node that a local task sums at once; combinations of bins counted together for nodes of at least as many rows, and of fewer.
SUM_ROWS = 1 << 17
JOINT_CELLS = (1 << 16, 1 << 10)


@dataclass(frozen=True)
class Boosting:
    """``leaves`` caps a tree's leaves (None: no cap); rows and columns are the shares drawn for each tree.

    objective "logistic" boosts; "share" makes trees of their own whose leaves are shares of label 1, with rows
    drawn with replacement if ``bootstrap`` and ``node_columns`` features drawn at each node (None: all)."""

    rounds: int = 300
    depth: int | None = 6
    step: float = 0.05
    leaves: int | None = None
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    rows: float = 1.0
    columns: float = 1.0
    seed: int = C.SEED
    objective: str = "logistic"
    bootstrap: bool = False
    node_columns: int | None = None


# ------------------------------------------------------------------------------------------------ growth
class Tree:
    """Arrays of a tree: children are -1 at leaves; a row goes left if its bin is at most ``cut``."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right = [], [], [], []
        self.totals, self.gain, self.path = [], [], []

    def add(self, totals: np.ndarray, path: str) -> int:
        for values, first in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.totals, totals), (self.gain, 0.0), (self.path, path)):
            values.append(first)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(a, np.int32) for a in (self.feature, self.cut, self.left, self.right))


def walk(arrays: tuple[np.ndarray, ...], codes: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
    """The leaf of every row, from the root or from the nodes where the rows are; ``codes`` has one line of bins per feature."""
    feature, cut, left, right = arrays
    node, rows = np.zeros(codes.shape[1], np.int32) if node is None else node, np.arange(codes.shape[1])
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        after = codes[np.maximum(f, 0), rows] > cut[node]
        node = np.where(inner, np.where(after, right[node], left[node]), node)


class Places:
    """Where the bins of some features lie in a histogram, one feature after the other."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray):
        sizes = np.diff(starts)[columns]
        self.at = np.concatenate([np.arange(starts[f], starts[f + 1]) for f in columns]) if len(columns) < len(starts) - 1 else slice(None)
        self.heads = np.cumsum(sizes) - sizes
        self.sizes = sizes
        self.inner = np.ones(int(sizes.sum()), bool)
        self.inner[self.heads + sizes - 1] = False  # all rows are at or below a feature's last bin
        self.place = np.arange(starts[-1])[self.at]


def best_split(hist: np.ndarray, total: np.ndarray, s: Boosting, places: Places, unit: float):
    """(gain, place of the last bin on the left, sums of the left side), or None. First feature and bin win ties."""
    sums = np.cumsum(hist[places.at], axis=0)
    before = np.zeros((len(places.heads), 3), np.int64)
    before[1:] = sums[places.heads[1:] - 1]
    n_all = int(total[2])
    n = sums[:, 2] - np.repeat(before[:, 2], places.sizes)
    least = max(s.min_rows, 1)
    some = np.flatnonzero((n >= least) & (n <= n_all - least) & places.inner)
    if not len(some):
        return None
    left = sums[some] - before[np.searchsorted(places.heads, some, "right") - 1]
    g, h = left[:, 0] / unit, left[:, 1] / unit
    g_all, h_all = total[0] / unit, total[1] / unit
    g2, h2 = g_all - g, h_all - h
    ok = (h >= s.min_hessian) & (h2 >= s.min_hessian) & (h + s.l2 > 0) & (h2 + s.l2 > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, g * g / (h + s.l2) + g2 * g2 / (h2 + s.l2) - g_all * g_all / (h_all + s.l2), -np.inf)
    at = int(np.argmax(gain))
    return (float(gain[at]), int(places.place[some[at]]), left[at]) if gain[at] > MIN_GAIN else None


def best_splits(slot: np.ndarray, place: np.ndarray, sums: np.ndarray, slots: int, s: Boosting, starts: np.ndarray, unit: float) -> list[tuple[np.ndarray, tuple | None]]:
    """(sums, ``best_split``) of every slot, from the ``sparse_sums`` of all of them: a cut at a bin without rows
    is one at the bin before, so bins that have rows are enough."""
    whole = place == starts[-1]
    totals = np.zeros((slots, 3), np.int64)
    totals[slot[whole]] = sums[whole]
    slot, place, sums = slot[~whole], place[~whole], sums[~whole]
    found: list[tuple | None] = [None] * slots
    owner = np.searchsorted(starts, place, "right")
    first = np.flatnonzero(np.append(True, (np.diff(slot) != 0) | (np.diff(owner) != 0))[: len(slot)])
    upto = np.cumsum(sums, axis=0)  # may wrap around; differences are exact all the same
    before = np.zeros((len(first), 3), np.int64)
    before[1:] = upto[first[1:] - 1]
    n = upto[:, 2] - np.repeat(before[:, 2], np.diff(np.append(first, len(slot))))
    n_all, least = totals[slot, 2], max(s.min_rows, 1)
    some = np.flatnonzero((n >= least) & (n <= n_all - least))
    if len(some):
        left, at, place = upto[some] - before[np.searchsorted(first, some, "right") - 1], slot[some], place[some]
        g, h = left[:, 0] / unit, left[:, 1] / unit
        g_all, h_all = totals[at, 0] / unit, totals[at, 1] / unit
        g2, h2 = g_all - g, h_all - h
        ok = (h >= s.min_hessian) & (h2 >= s.min_hessian) & (h + s.l2 > 0) & (h2 + s.l2 > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, g * g / (h + s.l2) + g2 * g2 / (h2 + s.l2) - g_all * g_all / (h_all + s.l2), -np.inf)
        heads = np.flatnonzero(np.append(True, np.diff(at) != 0))
        top = np.repeat(np.maximum.reduceat(gain, heads), np.diff(np.append(heads, len(at))))
        best = np.flatnonzero((gain == top) & (gain > MIN_GAIN))
        for i in best[np.unique(at[best], return_index=True)[1]].tolist():
            found[at[i]] = float(gain[i]), int(place[i]), left[i]
    return list(zip(totals, found))


def columns_of(s: Boosting, starts: np.ndarray, number: int, paths: Sequence[str]) -> np.ndarray:
    """The features that the nodes at some paths of a tree may be split by, ascending, a line per node."""
    features = len(starts) - 1
    if s.node_columns is None:
        return np.tile(drawn_columns(features, s, number), (len(paths), 1))
    drawn = [np.random.default_rng([s.seed, number, int("1" + p, 2)]).permutation(features)[: s.node_columns] for p in paths]
    return np.sort(np.array(drawn).reshape(len(paths), -1), axis=1)


def divisible(tree: Tree, families: Sequence[tuple[int, int, int]], s: Boosting) -> list[int]:
    """The nodes of some families that have rows enough for a split; the root's are not known yet."""
    return [c for _, *both in families for c in both if c >= 0 and (tree.totals[c] is None or tree.totals[c][2] >= 2 * max(s.min_rows, 1))]


def grow(s: Boosting, starts: np.ndarray) -> Generator:
    """A tree: yields (tree, families), a family being a node and its children, that of fewer rows first (for the root
    -1, 0, -1); gets {node: (its sums, its best split or None)} of the children that can be split; returns the tree."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    depth = math.inf if s.depth is None else s.depth
    tree = Tree()
    tree.add(None, "")
    families = [(-1, 0, -1)]
    tree.totals[0], split = (yield tree, families)[0]
    splits = {0: split} if depth else {}

    def chosen() -> list[int]:
        if s.leaves is None:
            return [v for v, left in enumerate(tree.left) if left >= 0]
        queue, taken = [(-splits[0][0], "", 0)] if splits.get(0) else [], []
        while queue and len(taken) < s.leaves - 1:
            node = heapq.heappop(queue)[2]
            taken.append(node)
            for child in (tree.left[node], tree.right[node]):
                if child >= 0 and splits.get(child):
                    heapq.heappush(queue, (-splits[child][0], tree.path[child], child))
        return taken

    def ready() -> list[int]:
        if s.leaves is None:
            return [c for _, *both in families for c in both if splits.get(c)]
        return [v for v in chosen() if tree.left[v] < 0]

    while new := ready():
        families = []
        for v in new:
            gain, at, left = splits[v]
            tree.feature[v], tree.cut[v], tree.gain[v] = int(owner[at]), int(at - starts[owner[at]]), gain
            a, b = tree.add(left, tree.path[v] + "0"), tree.add(tree.totals[v] - left, tree.path[v] + "1")
            tree.left[v], tree.right[v] = a, b
            if len(tree.path[a]) < depth:
                families.append((v, a, b) if tree.totals[a][2] <= tree.totals[b][2] else (v, b, a))
        if families:
            splits.update((c, split) for c, (_, split) in (yield tree, families).items())
    kept = set(chosen())
    final, number, todo = Tree(), {}, [0]
    while todo:
        v = todo.pop()
        number[v] = final.add(tree.totals[v], tree.path[v])
        if v in kept:
            todo += [tree.right[v], tree.left[v]]
    for v, i in number.items():
        if v in kept:
            final.feature[i], final.cut[i], final.gain[i] = tree.feature[v], tree.cut[v], tree.gain[v]
            final.left[i], final.right[i] = number[tree.left[v]], number[tree.right[v]]
    return final


def leaf_values(tree: Tree, s: Boosting, unit: float) -> np.ndarray:
    total = np.array(tree.totals, float) / [unit, unit, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(total[:, 1] + s.l2 > 0, -s.step * total[:, 0] / (total[:, 1] + s.l2), 0.0)
    return np.where(np.array(tree.left) < 0, value, 0.0)


# ----------------------------------------------------------------------------------------- rows of a block
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: P(count <= 0), P(count <= 1), ... of draws with replacement from many rows (Poisson of mean 1).
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def drawn_rows(keys: np.ndarray, s: Boosting, tree: int) -> np.ndarray:
    """How often each row counts in a tree, drawn by its key."""
    if s.rows >= 1 and not s.bootstrap:
        return np.ones(len(keys))
    draw = (_mix(keys ^ _mix(np.array([s.seed * 1_000_003 + tree + 1], np.uint64))) >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.searchsorted(_POISSON, draw, "right").astype(float) if s.bootstrap else (draw < s.rows).astype(float)


def drawn_columns(features: int, s: Boosting, tree: int) -> np.ndarray:
    count = max(1, int(s.columns * features))
    return np.sort(np.random.default_rng([s.seed, tree]).permutation(features)[:count])


def gradients(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, unit: float, objective: str = "logistic") -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the weighted logistic loss in whole units; for shares those of the squared error at 0."""
    if objective == "share":
        return np.rint(-y * weight * unit), np.rint(weight * unit)
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) * weight * unit), np.rint(p * (1 - p) * weight * unit)


def histograms(codes: np.ndarray, starts: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of (g, h, 1) by slot and bin, of the rows with a slot; whole numbers."""
    take = np.flatnonzero(slot >= 0)
    codes, slot, g, h = codes[:, take], slot[take].astype(np.int64), g[take], h[take]
    out = np.zeros((slots, int(starts[-1]), 3), np.int64)
    for f in range(len(starts) - 1):
        a, size = int(starts[f]), int(starts[f + 1] - starts[f])
        at = slot * size + codes[f]
        for k, weights in enumerate((g, h, None)):
            out[:, a : a + size, k] = np.bincount(at, weights, slots * size).reshape(slots, size)
    return out


def sparse_sums(codes: np.ndarray, starts: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray, columns: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(slot, place, sums of (g, h, 1)) of every bin with rows, in the columns of each slot, by slot and place; the
    place after the last bin holds all rows of a slot. Whole numbers. ``rows`` are those that slot, g and h are of, all of
    which have a slot; without it they are all rows."""
    if rows is None:
        rows = np.flatnonzero(slot >= 0)
        slot, g, h = slot[rows], g[rows], h[rows]
    slot = slot.astype(np.int64)
    sizes, width, flat = np.diff(starts), int(starts[-1]) + 1, codes.ravel()
    keys, sums = [], []
    for j in range(columns.shape[1] + 1):
        own = columns[:, j] if j < columns.shape[1] else None
        most = 1 if own is None or not len(own) else int(sizes[own].max())
        # one feature for all slots, as boosters have it, is a line of codes
        line = None if own is None else codes[own[0]].take(rows) if len(own) and (own == own[0]).all() else flat.take(own.take(slot) * codes.shape[1] + rows)
        at = slot if line is None else slot * most + line
        if slots * most <= 4 * len(at) + 65536:
            n = np.bincount(at, minlength=slots * most)
            here = np.flatnonzero(n)
            parts = [np.bincount(at, v, slots * most)[here] for v in (g, h)] + [n[here]]
        else:
            here, back = np.unique(at, return_inverse=True)
            parts = [np.bincount(back, v, len(here)) for v in (g, h, None)]
        keys.append(here * width + width - 1 if own is None else here // most * width + starts[own[here // most]] + here % most)
        sums.append(np.stack(parts, axis=1).astype(np.int64))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return key[order] // width, key[order] % width, np.concatenate(sums)[order]


# ------------------------------------------------------------------------------------------------ binning
@dataclass
class Binned:
    """Rows in blocks, the thresholds of every feature and what the weights sum to, for each weight column."""

    blocks: DataFrame
    thresholds: list[np.ndarray]
    weights: int
    rows: int
    units: list[float]

    @property
    def starts(self) -> np.ndarray:
        return np.append(0, np.cumsum([len(t) + 1 for t in self.thresholds]))


BLOCK_SCHEMA = "rows int, keys binary, codes binary, y binary, weights binary, margins binary"


def bin_rows(frame: DataFrame, features: Column | str, label: Column | str, weights: Sequence[Column], max_bins: int = MAX_BINS) -> Binned:
    """Bins ``frame``: ``features`` is an array of doubles, each weight a column that is 0 for rows left out.

    Missing or NaN entries count as 0, as the feature matrix fills them. Thresholds lie halfway between
    neighbouring (approximate) quantiles of all rows, at most ``max_bins`` a feature: of a feature with few
    values, halfway between every two of them.
    """
    spark = frame.sparkSession
    x = frame.select(
        (F.col(features) if isinstance(features, str) else features).alias("x"), (F.col(label) if isinstance(label, str) else label).cast("double").alias("y"),
        F.array(*[F.coalesce(w.cast("double"), F.lit(0.0)) for w in weights]).alias("w"),
    ).withColumn("x", F.transform("x", lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v)))
    path = scratch_path(spark, "boost-rows")
    x.write.parquet(path)
    x = spark.read.schema(x.schema).parquet(path)
    facts = x.agg(F.count(F.lit(1)), F.max(F.size("x")), *[F.max(F.col("w")[i]) for i in range(len(weights))]).first()
    n, d = facts[0], facts[1] or 0
    wide = x.select(*[F.col("x")[j].alias(f"f{j}") for j in range(d)])
    cuts = wide.approxQuantile(wide.columns, [i / max_bins for i in range(max_bins + 1)], 0.1 / max_bins) if n and d else []
    thresholds = []
    for values in map(np.unique, cuts):
        middle = values[:-1] / 2 + values[1:] / 2
        thresholds.append(np.where((middle < values[:-1]) | (middle >= values[1:]), values[:-1], middle))
    units = []
    for largest in facts[2:]:
        largest = (largest or 1.0) * len(_POISSON)  # a row may be drawn that often
        # sums of a block (or of all rows that may be local) stay below 2^53, sums of all rows below 2^62
        rows = max(BLOCK_ROWS, min(n, 1 << 20))
        room = min(52 - math.ceil(math.log2(rows)), 61 - math.ceil(math.log2(max(n, 2)))) - math.ceil(math.log2(max(largest, 1.0)))
        units.append(float(2 ** max(room, 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                size = part.num_rows
                values = np.asarray(part.column(1).flatten(), float).reshape(size, d)
                codes = np.stack([np.searchsorted(t, values[:, j], "left") for j, t in enumerate(thresholds)]).astype("<u2") if d else np.zeros((0, size), "<u2")
                w = np.asarray(part.column(3).flatten(), float)
                row = [size, np.asarray(part.column(0)).tobytes(), codes.tobytes(), np.asarray(part.column(2), float).tobytes(), w.tobytes(), bytes(8 * len(w))]
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row, [pa.int32(), *[pa.binary()] * 5])], ["rows", "keys", "codes", "y", "weights", "margins"])

    keyed = x.repartition(max(1, -(-n // (BLOCK_ROWS * BLOCKS_PER_PART)))).select(F.xxhash64("x", "y").alias("key"), "x", "y", "w")
    path = scratch_path(spark, "boost-blocks")
    keyed.mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)
    return Binned(spark.read.schema(BLOCK_SCHEMA).parquet(path), thresholds, len(weights), n, units)


class Block:
    """Arrays of one block; weights and margins have one line per weight column or model."""

    def __init__(self, row: dict, weights: int, models: int, kind: str | type = "<u2"):
        n = row["rows"]
        self.keys = np.frombuffer(row["keys"], np.int64).view(np.uint64)
        self.codes = np.frombuffer(row["codes"], kind).reshape(-1 if n else 0, n)
        self.y = np.frombuffer(row["y"], float)
        self.weights = np.ascontiguousarray(np.frombuffer(row["weights"], float).reshape(n, weights).T)
        have = np.frombuffer(row.get("margins", b""), float)
        self.margins = have.reshape(models, n) if len(have) == models * n else np.zeros((models, n))

    def of(self, column: int, starts: np.ndarray) -> Block:
        """The rows that count by one weight column, with that column alone and codes as narrow as they can be."""
        live, own = np.flatnonzero(self.weights[column] > 0), copy(self)
        own.keys, own.y, own.weights = self.keys[live], self.y[live], self.weights[column : column + 1, live]
        own.codes = np.empty((len(self.codes), len(live)), narrowest(starts))
        for to, codes in zip(own.codes, self.codes):
            to[:] = codes.take(live)
        return own


def narrowest(starts: np.ndarray) -> type:
    return np.uint8 if len(starts) < 2 or np.diff(starts).max() <= 256 else np.uint16


def merged(rows: list[dict], weights: int, models: int, kind: str | type = "<u2") -> Block:
    """All blocks as one."""
    parts = [Block(r, weights, models, kind) for r in rows]
    block = parts[0]
    if len(parts) > 1:
        block.keys, block.y = (np.concatenate([getattr(p, k) for p in parts]) for k in ("keys", "y"))
        block.codes, block.weights, block.margins = (np.concatenate([getattr(p, k) for p in parts], axis=1) for k in ("codes", "weights", "margins"))
    return block


def chunks(batches: Iterator[pa.RecordBatch], weights: int, models: int) -> Iterator[Block]:
    """The blocks of a task in chunks of at most CHUNK_ROWS rows, or of one block."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and sum(r["rows"] for r in rows) + row["rows"] > CHUNK_ROWS:
                yield merged(rows, weights, models)
                rows = []
            rows.append(row)
    if rows:
        yield merged(rows, weights, models)


# ----------------------------------------------------------------------------------------------- training
def start_margin(positive: float, whole: float) -> float:
    """Log odds of the weighted labels; 0 if there is only one label."""
    return math.log(positive / (whole - positive)) if 0 < positive < whole else 0.0


def _table(tree: Tree, s: Boosting, unit: float, thresholds: list[np.ndarray]) -> dict:
    feature = np.array(tree.feature, np.int32)
    cut = [float(thresholds[f][c]) if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]
    return {"feature": feature, "threshold": np.array(cut), "left": np.array(tree.left, np.int32), "right": np.array(tree.right, np.int32),
            "cover": np.array([float(t[2]) for t in tree.totals]), "value": leaf_values(tree, s, unit), "gain": np.array(tree.gain)}


TREE_FIELDS = "tree int, feature array<int>, threshold array<double>, `left` array<int>, `right` array<int>, cover array<double>, value array<double>, gain array<double>"
_ARRAYS = ["feature", "threshold", "left", "right", "cover", "value", "gain"]
_WHOLE = ("feature", "left", "right")


class Joint:
    """Features of a block counted together: those of few bins share a code, one for each combination of their bins, as long
    as there are at most ``cells`` combinations. Sums of a feature are sums over the others' bins."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, cells: int):
        self.starts, sizes = starts, np.diff(starts)
        groups: list[list[int]] = []
        for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
            m = next((m for m in groups if math.prod(int(sizes[i]) for i in m) * int(sizes[f]) <= cells), None)
            if m is None:
                groups.append(m := [])
            m.append(f)
        self.members = groups
        self.shapes = [tuple(int(sizes[f]) for f in m) for m in groups]
        self.cells = max((math.prod(shape) for shape in self.shapes), default=0)
        self.codes = []
        for m in groups:
            code = codes[m[0]] if len(m) == 1 else codes[m[0]].astype(np.uint16 if math.prod(int(sizes[f]) for f in m) <= 1 << 16 else np.uint32)
            for f in m[1:]:
                code = code * code.dtype.type(sizes[f]) + codes[f]
            self.codes.append(code)

    def sums(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, columns: set[int]) -> np.ndarray:
        """``histograms`` of some rows as one slot; features not in ``columns`` may be left 0."""
        out = np.zeros((int(self.starts[-1]), 3), np.int64)
        for a in range(0, len(rows), SUM_ROWS):  # sums of so many rows are exact
            some = rows[a : a + SUM_ROWS]
            weights = g.take(some), h.take(some), None
            for m, shape, code in zip(self.members, self.shapes, self.codes):
                if columns.isdisjoint(m):
                    continue
                at, size = code.take(some).astype(np.intp), math.prod(shape)
                for k, v in enumerate(weights):
                    sums = np.bincount(at, v, size).reshape(shape)
                    for i, f in enumerate(m):
                        out[self.starts[f] : self.starts[f + 1], k] += sums.sum(axis=tuple(j for j in range(len(m)) if j != i)).astype(np.int64)
        return out


def _by_histograms(block: Block, s: Boosting, starts: np.ndarray, number: int, unit: float, weight, g, h):
    """Answers for ``grow`` from whole histograms: of two children only the smaller is gathered, the other is its parent less it.
    Rows are kept by node, so a pass reads only those of the nodes that it gathers."""
    drawn = drawn_columns(len(starts) - 1, s, number)
    places, columns = Places(starts, drawn), set(drawn.tolist())
    keep = max(2, KEPT_BYTES // (24 * int(starts[-1])))
    hist: dict[int, np.ndarray] = {}
    rows = {0: np.flatnonzero(weight > 0)}

    def gathered(node: int) -> np.ndarray:
        own = rows[node]
        return next(j for j in block.joint if len(own) >= j.cells or j is block.joint[-1]).sums(own, g, h, columns)

    def answer(tree: Tree, families: list[tuple[int, int, int]]) -> dict:
        parents = {v for v, *_ in families}
        for v in [v for v in rows if tree.left[v] >= 0]:
            own = rows.pop(v)
            if v in parents:
                before = block.codes[tree.feature[v]].take(own) <= tree.cut[v]
                rows[tree.left[v]], rows[tree.right[v]] = own.take(np.flatnonzero(before)), own.take(np.flatnonzero(~before))
        for v in [v for v in hist if tree.left[v] >= 0 and v not in parents]:
            del hist[v]
        found = {}
        for v, small, large in families:
            parent, own = hist.pop(v, None), gathered(small)
            # a parent whose histogram was not kept needs both of its children gathered
            for c, sums in ((small, own), *([] if large < 0 else [(large, gathered(large) if parent is None else parent - own)])):
                total = sums[starts[drawn[0]] : starts[drawn[0] + 1]].sum(axis=0)
                found[c] = total, best_split(sums, total, s, places, unit)
                if found[c][1] and len(hist) < keep:
                    hist[c] = sums
                if not found[c][1]:
                    rows.pop(c)
        return found

    return answer


def spread(arrays: tuple[np.ndarray, ...], codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, its rows) of a tree."""
    feature, cut, left, right = arrays
    todo = [(0, np.arange(codes.shape[1]))]
    while todo:
        node, rows = todo.pop()
        if feature[node] < 0:
            yield node, rows
            continue
        before = codes[feature[node]].take(rows) <= cut[node]
        todo += [(left[node], rows.take(np.flatnonzero(before))), (right[node], rows.take(np.flatnonzero(~before)))]


def _by_columns(block: Block, s: Boosting, starts: np.ndarray, number: int, unit: float, weight, g, h):
    """Answers for ``grow`` from the sums of each node's own columns; rows go on from the nodes where they are, until these are leaves."""
    rows = np.flatnonzero(weight > 0)
    g, h, slot, before, flat = g[rows], h[rows], np.zeros(len(rows), np.int32), [-1], block.codes.ravel()

    def answer(tree: Tree, families: list[tuple[int, int, int]]) -> dict:
        nonlocal rows, g, h, slot, before
        nodes = divisible(tree, families, s)
        if before != [-1]:
            slot_of = {c: i for i, c in enumerate(nodes)}
            feature, cut = (np.array([v[b] for b in before]) for v in (tree.feature, tree.cut))
            to_left, to_right = (np.array([slot_of.get(v[b], -1) for b in before], np.int32) for v in (tree.left, tree.right))
            goes_left = flat.take(np.maximum(feature, 0).take(slot) * len(block.y) + rows) <= cut.take(slot)
            slot = np.where(goes_left, to_left.take(slot), to_right.take(slot))
            on = np.flatnonzero(slot >= 0)
            rows, g, h, slot = rows.take(on), g.take(on), h.take(on), slot.take(on)
        before = nodes
        if not nodes:
            return {}
        columns = columns_of(s, starts, number, [tree.path[c] for c in nodes])
        return dict(zip(nodes, best_splits(*sparse_sums(block.codes, starts, slot, len(nodes), g, h, columns, rows), len(nodes), s, starts, unit)))

    return answer


def boost_block(block: Block, column: int, s: Boosting, starts: np.ndarray, unit: float, base: float, numbers: Sequence[int] | None = None) -> Iterator[Tree]:
    """The trees of one model on the rows of one block, one after the other (of a forest, those of some numbers)."""
    block = block.of(column, starts)
    margin, whole = np.full(len(block.y), base), s.node_columns is None
    if whole:
        block.joint = [Joint(block.codes, starts, cells) for cells in JOINT_CELLS]
    for number in range(s.rounds) if numbers is None else numbers:
        growing = grow(s, starts)
        asked = next(growing)
        weight = block.weights[0] * drawn_rows(block.keys, s, number)
        answer = (_by_histograms if whole else _by_columns)(block, s, starts, number, unit, weight, *gradients(margin, block.y, weight, unit, s.objective))
        while True:
            try:
                asked = growing.send(answer(*asked))
            except StopIteration as done:
                tree = done.value
                break
        if s.objective == "logistic":
            values = leaf_values(tree, s, unit)
            for leaf, rows in spread(tree.arrays(), block.codes):
                margin[rows] += values[leaf]
        yield tree


def _units(models: list[tuple[Boosting, int]], tasks: int) -> list[tuple[int, int, int]]:
    """(model, first tree, end): a booster is one unit and comes before forests, a forest has one for each group of trees."""
    single = sum(s.rounds for s, _ in models if s.objective == "share")
    step = {m: s.rounds if s.objective == "logistic" else max(1, GROUP, -(-single // tasks)) for m, (s, _) in enumerate(models)}
    order = sorted(step, key=lambda m: models[m][0].objective == "share")
    return [(m, a, min(a + step[m], models[m][0].rounds)) for m in order for a in range(0, models[m][0].rounds, max(1, step[m]))]


def _train_local(binned: Binned, models: list[tuple[Boosting, int]], bases: list[float]) -> list[list[dict]]:
    """Every unit is a task that gets the rows of its weight column, shuffled to it; the trees come by a written table."""
    spark, starts, width, thresholds, unit_of = binned.blocks.sparkSession, binned.starts, binned.weights, binned.thresholds, binned.units
    units = _units(models, 4 * spark.sparkContext.defaultParallelism)
    found: list[list[dict]] = [[] for _ in models]
    if not units:
        return found
    users = [[u for u, (m, *_) in enumerate(units) if models[m][1] == column] for column in range(width)]

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, width, 1)
                for column, own in enumerate(users):
                    if own:
                        b = block.of(column, starts)
                        values = [own, len(b.y), *[v.tobytes() for v in (b.keys, b.codes, b.y, b.weights)]]
                        yield pa.record_batch([pa.array([v], t) for v, t in zip(values, [pa.list_(pa.int32()), pa.int32(), *[pa.binary()] * 4])], ["units", "rows", "keys", "codes", "y", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def whole() -> Block:
            some = [row for row in held if row["rows"]] or held[:1]
            held.clear()
            block = merged(some, 1, 1, narrowest(starts))
            block.codes = block.codes.reshape(len(thresholds), -1)
            return block

        def trees() -> Iterator[pa.RecordBatch]:
            m, first, end = units[now]
            s, column = models[m]
            for number, tree in zip(range(first, end), boost_block(whole(), 0, s, starts, unit_of[column], bases[m], range(first, end))):
                table = _table(tree, s, unit_of[column], thresholds)
                yield pa.record_batch([pa.array([m], pa.int32()), pa.array([number], pa.int32()), *[pa.array([table[k].tobytes()], pa.binary()) for k in _ARRAYS]], ["model", "tree", *_ARRAYS])

        for batch in batches:
            rows = batch.to_pylist()[::-1]
            del batch
            while rows:
                row = rows.pop()
                if now not in (None, row["unit"]):
                    yield from trees()
                now = row["unit"]
                held.append(row)
        row = None
        if now is not None:
            yield from trees()

    dealt = binned.blocks.mapInArrow(narrow, "units array<int>, rows int, keys binary, codes binary, y binary, weights binary") \
        .select(F.explode("units").alias("unit"), "rows", "keys", "codes", "y", "weights").repartitionById(len(units), "unit").sortWithinPartitions("unit")
    path = scratch_path(spark, "boost-trees")
    dealt.mapInArrow(run, "model int, tree int, " + ", ".join(f"`{k}` binary" for k in _ARRAYS)).write.parquet(path)
    parts: list[dict[int, dict]] = [{} for _ in models]
    for r in spark.read.parquet(path).toLocalIterator():
        parts[r["model"]][r["tree"]] = {k: np.frombuffer(r[k], np.int32 if k in _WHOLE else float) for k in _ARRAYS}
    return [[trees[i] for i in sorted(trees)] for trees in parts]


def _grown(binned: Binned, state: DataFrame, models: list[tuple[Boosting, int]], trees: list[tuple[int, int]]) -> list[Tree]:
    """Grows trees (model, number) together over the blocks of ``state``: a job per pass, or per JOB_BYTES of sums.

    Tasks sum their rows by node and bin, others add these sums up and search them for splits, some nodes (a pack) at
    a time. The driver gets a line per node, however many bins and partitions there are."""
    spark, starts, width, unit_of = state.sparkSession, binned.starts, binned.weights, binned.units
    places = int(starts[-1]) + 1
    growing = [grow(models[m][0], starts) for m, _ in trees]
    open_ = {i: next(g) for i, g in enumerate(growing)}
    done: dict[int, Tree] = {}

    def searched(ask: list[tuple]) -> pa.Table:
        shared = spark.sparkContext.broadcast(ask)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, width, len(models)):
                for at, (i, arrays, nodes, columns, pack) in enumerate(shared.value):
                    m, number = trees[i]
                    s, column = models[m]
                    slot_of = np.full(len(arrays[0]), -1, np.int32)
                    slot_of[nodes] = np.arange(len(nodes))
                    weight = b.weights[column] * drawn_rows(b.keys, s, number)
                    slot = np.where(weight > 0, slot_of[walk(arrays, b.codes)], -1)
                    slot, place, sums = sparse_sums(b.codes, starts, slot, len(nodes), *gradients(b.margins[m], b.y, weight, unit_of[column], s.objective), columns)
                    key = slot * places + place
                    packs = np.unique(slot // pack)
                    ends = np.searchsorted(slot, np.append(packs * pack, len(nodes)))
                    out = [[at] * len(packs), packs, *[[v[a:z].tobytes() for a, z in zip(ends, ends[1:])] for v in (key, sums)]]
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(out, [pa.int32(), pa.int32(), pa.binary(), pa.binary()])], ["ask", "pack", "keys", "sums"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []

            def added() -> tuple[np.ndarray, np.ndarray]:
                key, sums = np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])
                order = np.argsort(key, kind="stable")
                key = key[order]
                heads = np.flatnonzero(np.append(True, np.diff(key) != 0))
                return key[heads], np.add.reduceat(sums[order], heads, axis=0)

            def result() -> pa.RecordBatch:
                at, pack_no = now
                i, _, nodes, _, pack = shared.value[at]
                s, column = models[trees[i][0]]
                key, sums = added()
                first = pack_no * pack
                own = nodes[first : first + pack]
                found = best_splits(key // places - first, key % places, sums, len(own), s, starts, unit_of[column])
                total = np.stack([t for t, _ in found])
                left = np.stack([np.zeros(3, np.int64) if p is None else p[2] for _, p in found])
                gain, place = [0.0 if p is None else p[0] for _, p in found], [-1 if p is None else p[1] for _, p in found]
                values = [[i] * len(own), own, gain, place, *left.T, *total.T]
                return pa.record_batch([pa.array(v, t) for v, t in zip(values, [pa.int32(), pa.int32(), pa.float64(), pa.int32()] + [pa.int64()] * 6)], _SPLIT_NAMES)

            for batch in batches:
                for row in batch.to_pylist():
                    if now not in (None, (row["ask"], row["pack"])):
                        yield result()
                        held = []
                    now = row["ask"], row["pack"]
                    held.append((np.frombuffer(row["keys"], np.int64), np.frombuffer(row["sums"], np.int64).reshape(-1, 3)))
                    if len(held) > 1 and sum(len(k) for k, _ in held) > PACK_CELLS * 8 + 2 * len(held[0][0]):
                        held = [added()]
            if now is not None:
                yield result()

        packs = sum(-(-len(nodes) // pack) for _, _, nodes, _, pack in ask)
        try:
            rows = state.mapInArrow(run, "ask int, pack int, keys binary, sums binary")
            parts = max(1, min(packs, max(spark.sparkContext.defaultParallelism, packs // 64)))
            return rows.repartition(parts, "ask", "pack").sortWithinPartitions("ask", "pack").mapInArrow(search, _SPLIT_SCHEMA).toArrow()
        finally:
            shared.unpersist()

    while open_:
        found: dict[int, dict] = {i: {} for i in open_}
        ask: list[tuple] = []
        size = 0

        def settle() -> None:
            got = searched(ask)
            i, node, gain, place, *sums = (got[c].to_numpy() for c in _SPLIT_NAMES)
            sums = np.stack(sums, axis=1).astype(np.int64)
            for j in range(len(i)):
                found[int(i[j])][int(node[j])] = sums[j, 3:], (float(gain[j]), int(place[j]), sums[j, :3]) if place[j] >= 0 else None

        for i, (tree, families) in open_.items():
            m, number = trees[i]
            nodes = divisible(tree, families, models[m][0])
            found[i] = {c: (np.zeros(3, np.int64), None) for c in nodes}
            if not nodes:
                continue
            columns = columns_of(models[m][0], starts, number, [tree.path[c] for c in nodes])
            cells = max(1, int(np.diff(starts)[columns].sum(axis=1).max()))
            most = 32 * min(len(nodes) * cells * max(1, -(-binned.rows // CHUNK_ROWS)), binned.rows * columns.shape[1])
            if ask and size + most > JOB_BYTES:
                settle()
                ask, size = [], 0
            ask.append((i, tree.arrays(), np.array(nodes, np.int32), columns, max(1, PACK_CELLS // cells)))
            size += most
        if ask:
            settle()
        still = {}
        for i, answer in found.items():
            try:
                still[i] = growing[i].send(answer)
            except StopIteration as end:
                done[i] = end.value
        open_ = still
    return [done[i] for i in range(len(trees))]


_SPLIT_SCHEMA = "tree int, node int, gain double, place int, g long, h long, n long, g_all long, h_all long, n_all long"
_SPLIT_NAMES = [c.split()[0] for c in _SPLIT_SCHEMA.split(", ")]


def _train_spark(binned: Binned, models: list[tuple[Boosting, int]], bases: list[float]) -> list[list[dict]]:
    spark, width = binned.blocks.sparkSession, binned.weights
    units, state, held = binned.units, binned.blocks, []
    found: list[list[dict]] = [[] for _ in models]

    def keep(m: int, tree: Tree) -> None:
        found[m].append(_table(tree, models[m][0], units[models[m][1]], binned.thresholds))

    single = [(m, number) for m, (s, _) in enumerate(models) if s.objective == "share" for number in range(s.rounds)]
    for a in range(0, len(single), TOGETHER):
        for (m, _), tree in zip(single[a : a + TOGETHER], _grown(binned, binned.blocks, models, single[a : a + TOGETHER])):
            keep(m, tree)
    boosters = [m for m, (s, _) in enumerate(models) if s.objective == "logistic"]
    last: list[tuple | None] = [None] * len(models)  # the trees of the round before, not yet in the margins
    for number in range(max((models[m][0].rounds for m in boosters), default=0)):
        live = [m for m in boosters if number < models[m][0].rounds]
        step = spark.sparkContext.broadcast((last, bases if number == 0 else None))

        def advance(batches: Iterator[pa.RecordBatch], step=step) -> Iterator[pa.RecordBatch]:
            trees, begin = step.value
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row, width, len(models))
                    margins = block.margins.copy() if begin is None else np.repeat(np.array(begin)[:, None], len(block.y), axis=1)
                    for m, tree in enumerate(trees):
                        if tree is not None:
                            margins[m] += tree[1][walk(tree[0], block.codes)]
                    row["margins"] = margins.tobytes()
                    yield pa.RecordBatch.from_pylist([row], batch.schema)

        state = state.mapInArrow(advance, BLOCK_SCHEMA)
        if number % CUT_ROUNDS == CUT_ROUNDS - 1:
            path = scratch_path(spark, "boost-margins")
            state.write.parquet(path)
            state = spark.read.schema(BLOCK_SCHEMA).parquet(path)
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(state)
        if len(held) > 2:
            held.pop(0).unpersist()
        last = [None] * len(models)
        for m, tree in zip(live, _grown(binned, state, models, [(m, number) for m in live])):
            keep(m, tree)
            last[m] = (tree.arrays(), leaf_values(tree, models[m][0], units[models[m][1]]))
    for frame in held:
        frame.unpersist()
    return found


def train(binned: Binned, models: Sequence[tuple[Boosting, int]], from_average: bool = False) -> list[list[dict]]:
    """Trees of every model (settings, weight column), all trained on the same binned rows; see the module's text."""
    models = list(models)
    if not binned.rows:
        return [[] for _ in models]
    bases = [0.0] * len(models)
    if from_average:
        found = binned.blocks.mapInArrow(_label_sums(binned.weights), "i int, pos double, whole double").groupBy("i").agg(F.sum("pos").alias("p"), F.sum("whole").alias("w")).collect()
        by_column = {r["i"]: start_margin(r["p"], r["w"]) for r in found}
        bases = [by_column.get(column, 0.0) for _, column in models]
    cells = binned.rows * (2 * len(binned.thresholds) + 8 * 3)
    trees = (_train_local if cells <= LOCAL_CELLS else _train_spark)(binned, models, bases)
    return [[{"base": b, **t} for t in ts] for b, ts in zip(bases, trees)]


def _label_sums(weights: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, weights, 1)
                yield pa.record_batch([pa.array(range(weights), pa.int32()), pa.array((b.weights * b.y).sum(axis=1)), pa.array(b.weights.sum(axis=1))], ["i", "pos", "whole"])

    return run


# -------------------------------------------------------------------------------------------------- model
class TreesModel(Model, MLReadable, MLWritable):
    """Fitted trees as a Spark ML stage: reads a vector column, adds rawPrediction, probability and prediction.

    ``output`` "margin" sums the trees' leaves to log odds, "share" averages them to a probability. The trees are kept
    as arrays (as ``explain`` reads them) and saved as a Parquet table beside the metadata.
    """

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column of features", TypeConverters.toString)
    importanceType = Param(Params._dummy(), "importanceType", "'gain' (mean gain of a feature's splits), 'split' (their number) or 'impurity' (share of each tree's decrease)", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "'margin' or 'share'", TypeConverters.toString)
    numFeatures = Param(Params._dummy(), "numFeatures", "length of the vectors", TypeConverters.toInt)
    base = Param(Params._dummy(), "base", "margin before the first tree", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", importanceType: str = "gain", output: str = "margin", numFeatures: int = 0, base: float = 0.0, trees: list[dict] | None = None):
        super().__init__()
        self.trees = trees or []
        self._set(featuresCol=featuresCol, importanceType=importanceType, output=output, numFeatures=numFeatures, base=base)

    def prefix(self, rounds: int) -> TreesModel:
        """The model as it was after its first ``rounds`` trees."""
        return TreesModel(**{p.name: self.getOrDefault(p) for p in self.params}, trees=self.trees[:rounds])

    @property
    def featureImportances(self) -> DenseVector:
        d, kind = self.getOrDefault("numFeatures"), self.getOrDefault("importanceType")
        gain, times = np.zeros(d), np.zeros(d)
        for t in self.trees:
            inner = t["left"] >= 0
            own = np.bincount(t["feature"][inner], t["gain"][inner], d)
            gain += own / max(own.sum(), 1e-300) if kind == "impurity" else own
            times += np.bincount(t["feature"][inner], minlength=d)
        value = {"split": times, "impurity": gain, "gain": gain / np.maximum(times, 1)}[kind]
        return DenseVector(value / value.sum() if value.sum() > 0 else value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # the trees as plain arrays: one evaluation step is one vectorised look-up for a batch
        shared = dataset.sparkSession.sparkContext.broadcast(([{k: t[k] for k in ("feature", "threshold", "left", "right", "value")} for t in self.trees], self.getOrDefault("base")))

        @F.pandas_udf("double")
        def total(x: pd.Series) -> pd.Series:
            trees, base = shared.value
            values = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, 1))
            sums, flat = np.full(len(x), base), values.ravel()
            for t in trees:
                # rows stay in the walk until they are at a leaf
                rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
                while len(rows):
                    inner = t["left"].take(node) >= 0
                    done = np.flatnonzero(~inner)
                    if len(done):
                        sums[rows.take(done)] += t["value"].take(node.take(done))
                        on = np.flatnonzero(inner)
                        rows, node = rows.take(on), node.take(on)
                    before = flat.take(rows * values.shape[1] + t["feature"].take(node)) <= t["threshold"].take(node)
                    node = np.where(before, t["left"].take(node), t["right"].take(node))
            return pd.Series(sums)

        out = dataset.withColumn("__total", total(vector_to_array(F.col(self.getOrDefault("featuresCol")))))
        if self.getOrDefault("output") == "share":
            p = F.col("__total") / F.lit(float(max(1, len(self.trees))))
            raw = F.array(1 - p, p)
        else:
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__total")))
            raw = F.array(-F.col("__total"), F.col("__total"))
        return out.withColumns({"rawPrediction": array_to_vector(raw), "probability": array_to_vector(F.array(1 - p, p)), "prediction": (p > 0.5).cast("double")}).drop("__total")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: TreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        rows = [(i, *[t[k].tolist() for k in _ARRAYS]) for i, t in enumerate(self.model.trees)]
        self.sparkSession.createDataFrame(rows, TREE_FIELDS).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TreesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/trees").orderBy("tree").collect()
        model = self.cls(trees=[{k: np.array(r[k], np.int32 if k in _WHOLE else float) for k in _ARRAYS} for r in rows])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def as_model(trees: list[dict], s: Boosting, features: int, features_col: str = "features") -> TreesModel:
    """The trees of one model as a stage."""
    kind = "impurity" if s.objective == "share" else "gain" if s.leaves is None else "split"
    return TreesModel(featuresCol=features_col, importanceType=kind, output="share" if s.objective == "share" else "margin", numFeatures=features,
                      base=trees[0]["base"] if trees else 0.0, trees=[{k: np.asarray(t[k]) for k in _ARRAYS} for t in trees])
