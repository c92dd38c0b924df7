"""Exact k-nearest neighbours among the rows of a DataFrame, distributed.

1. Equal vectors are collapsed first (vector, multiplicity): a value held by a
   third of all rows becomes one point, and its own copies are its nearest
   neighbours at distance 0.
2. A tree of cells: a cell of more than ``block`` rows is cut in two across the feature
   in which a sample of its rows (those with the smallest hashes) varies most, at the
   sample's median, and so on, until no leaf holds more than a block. Each scan cuts a cell
   up to ``LEVELS`` times. Every cell, inner ones too, knows the box of its members: the
   smallest and the largest value in every feature.
3. Round 1: every query probes a few near leaves (a beam search down the tree) and
   keeps its k nearest members found there; r_k(q) bounds its true k-th distance.
4. Round 2 (verification): a cell can hold a closer point only if its box is no farther
   from q than r_k(q). The tree is walked from its root, cells that cannot are left out
   with all below them, and the leaves that remain are probed. After this round the k
   nearest are exact. Boxes follow features that take few values, which balls around a
   centre do not: with balls most leaves stay, and the probes grow with the square of the rows.

When all distinct vectors fit in one block, a single probe of that block is
already exact and the tree is skipped.

A probe is a co-group on (leaf, member block, query block): the queries probing a
leaf are split into blocks of at most ``block`` rows (and so are its members, should a
leaf be larger), so every task holds two bounded blocks, computes their distance
matrix in numpy and emits only the k nearest per query. No pair is ever materialised
as a row. The tree (cuts and boxes) is broadcast; it may have ``TREE_BYTES`` at most,
and leaves are let grow beyond a block where that would not do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake import config as C

HIT_SCHEMA = "qid long, dist double, nid long"
LEVELS = 4          # cuts of a cell, one below the other, in one scan
SAMPLE = 1024       # rows of a cell that its cuts are chosen by
TREE_BYTES = 128 << 20


class CellTree:
    """Cells as arrays: the feature and value a cell is cut at, its two children (-1 where there are none) and the
    box of its members; cell 0 holds all rows."""

    def __init__(self, width: int):
        self.children = np.full((1, 2), -1, np.int32)
        self.axis = np.zeros(1, np.int32)
        self.cut = np.zeros(1)
        self.low = np.full((1, width), np.inf)
        self.high = np.full((1, width), -np.inf)

    @property
    def centres(self) -> np.ndarray:
        """Of the ball around each cell's box."""
        return (self.low + self.high) / 2

    @property
    def radii(self) -> np.ndarray:
        """Of the ball around each cell's box."""
        return np.sqrt((np.maximum(self.high - self.centres, self.centres - self.low) ** 2).sum(axis=1))

    def split(self, cells: np.ndarray, axes: np.ndarray, cuts: np.ndarray) -> None:
        """Cuts leaves in two: a member goes to the first child up to the cut, to the second above it."""
        first, more = len(self.children), 2 * len(cells)
        self.axis[cells], self.cut[cells] = axes, cuts
        self.children[cells] = first + np.arange(more).reshape(-1, 2)
        self.children = np.concatenate([self.children, np.full((more, 2), -1, np.int32)])
        self.axis = np.concatenate([self.axis, np.zeros(more, np.int32)])
        self.cut = np.concatenate([self.cut, np.zeros(more)])
        self.low = np.concatenate([self.low, np.full((more, self.low.shape[1]), np.inf)])
        self.high = np.concatenate([self.high, np.full((more, self.high.shape[1]), -np.inf)])

    def fit_boxes(self, leaves: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Takes the boxes of the leaves; that of an inner cell spans its children's."""
        self.low[leaves], self.high[leaves] = low, high
        for cell in range(len(self.children) - 1, -1, -1):  # children come after their cell
            if self.children[cell, 0] >= 0:
                self.low[cell] = self.low[self.children[cell]].min(axis=0)
                self.high[cell] = self.high[self.children[cell]].max(axis=0)

    def is_leaf(self, cells: np.ndarray) -> np.ndarray:
        return self.children[cells, 0] < 0

    def distances(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Of each row of x to the box of its cell: no member of the cell is nearer."""
        return np.sqrt((np.maximum(np.maximum(self.low[cells] - x, x - self.high[cells]), 0) ** 2).sum(axis=-1))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row belongs to."""
        cell = np.zeros(len(x), np.int64)
        while len(down := np.flatnonzero(~self.is_leaf(cell))):
            at = cell[down]
            above = ~(x[down, self.axis[at]] <= self.cut[at])
            cell[down] = self.children[at, above.astype(int)]
        return cell

    def near_leaves(self, x: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` leaves near each row, by a beam search; -1 where there are fewer."""
        beam = np.full((len(x), width), -1, np.int64)
        beam[:, 0] = 0
        while True:
            inner = (beam >= 0) & ~self.is_leaf(np.maximum(beam, 0))
            if not inner.any():
                return beam
            below = np.where(inner[:, :, None], self.children[np.maximum(beam, 0)], -1).reshape(len(x), -1)
            every = np.concatenate([np.where(inner, -1, beam), below], axis=1)
            far = np.where(every >= 0, self.distances(x[:, None, :], np.maximum(every, 0)), np.inf)
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            beam = np.take_along_axis(every, order, axis=1)

    def reachable(self, x: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, leaf) of all leaves that may hold a point within reach of a row."""
        row, cell = np.arange(len(x)), np.zeros(len(x), np.int64)
        while len(row):
            rows, cells = [], []
            for a in range(0, len(row), 8192):
                r, c = row[a : a + 8192], cell[a : a + 8192]
                may = self.distances(x[r], c) <= reach[r] * (1 + 1e-9) + 1e-9  # slack for rounding: probe, never skip
                r, c = r[may], c[may]
                leaf = self.is_leaf(c)
                if leaf.any():
                    yield r[leaf], c[leaf]
                rows.append(np.repeat(r[~leaf], 2))
                cells.append(self.children[c[~leaf]].ravel().astype(np.int64))
            row, cell = np.concatenate(rows), np.concatenate(cells)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _cuts(x: np.ndarray, levels: int) -> list[tuple[int, int, float]]:
    """(node, feature, value) of up to ``levels`` cuts, one below the other, by a cell's sample x. Nodes are numbered
    from 1, the children of node i are 2i and 2i + 1. Rows that do not differ are not cut."""
    found, todo = [], [(1, x)]
    while todo:
        node, part = todo.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        with np.errstate(invalid="ignore", over="ignore"):
            spread = np.where(high > low, np.nan_to_num(part.var(axis=0)), -1.0)
        axis = int(spread.argmax())
        if spread[axis] < 0:
            continue
        values = np.sort(part[:, axis])
        cut = values[(len(values) - 1) // 2]
        if cut == values[-1]:
            cut = values[values < cut][-1]
        found.append((node, axis, float(cut)))
        if 2 * node < 1 << levels:
            first = part[:, axis] <= cut
            todo += [(2 * node, part[first]), (2 * node + 1, part[~first])]
    return found


def _drawn(placed: DataFrame, large: DataFrame, seed: int) -> DataFrame:
    """Of the rows (id, f, cell) of the cells in ``large`` (cell, levels, n) those that may be among a cell's SAMPLE
    smallest hashes: about twice as many, so the task that ranks a cell never gets all its rows."""
    share = F.lit(2.0 * SAMPLE) / F.col("n")
    return placed.join(F.broadcast(large), "cell").withColumn("h", F.xxhash64("id", F.lit(seed), "cell")) \
        .where(F.col("h").cast("double") <= F.lit(-2.0 ** 63) + F.lit(2.0 ** 64) * share)


def grow_cells(points: DataFrame, block: int, seed: int) -> CellTree:
    """Splits cells of ``points`` (id, f) until no leaf holds more than ``block`` rows; see the module's text."""
    spark = points.sparkSession
    width = len(points.first()["f"])
    tree = CellTree(width)
    cell_bytes, n = 16 * width + 20, points.count()
    # about 3 * n / block leaves and as many inner cells at most; more than the tree may hold would not be broadcast
    block = max(block, 1 + 6 * n * cell_bytes // TREE_BYTES)

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_cuts(_matrix(pdf["f"]), int(pdf["levels"].iloc[0])), columns=["node", "axis", "cut"])
        return out.assign(cell=pdf["cell"].iloc[0])[["cell", "node", "axis", "cut"]]

    while True:
        shared = spark.sparkContext.broadcast(tree)

        def assign(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf):
                    yield pdf.assign(cell=shared.value.leaf_of(_matrix(pdf["f"])))

        placed = points.select("id", "f").mapInPandas(assign, "id long, f array<double>, cell long")
        large = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
        # as many cuts as bring a cell under a block, with room for uneven ones
        large = large.select("cell", F.least(F.lit(LEVELS), F.ceil(F.log2(1.5 * F.col("n") / block)).cast("int")).alias("levels"), "n")
        rank = F.row_number().over(Window.partitionBy("cell").orderBy("h", "id"))
        sample = _drawn(placed, large, seed).withColumn("r", rank).where(F.col("r") <= SAMPLE).select("cell", "levels", "f")
        found = sample.groupBy("cell").applyInPandas(cuts, "cell long, node int, axis int, cut double").toPandas()
        if not len(found):
            break
        place = {(cell, 1): cell for cell in found["cell"]}
        for depth in range(LEVELS):  # the cuts of one depth of all cells at a time
            level = found[(found["node"] >= 1 << depth) & (found["node"] < 2 << depth)]
            at = np.array([place[pair] for pair in zip(level["cell"], level["node"])], np.int64)
            tree.split(at, level["axis"].to_numpy(), level["cut"].to_numpy())
            for cell, node, children in zip(level["cell"], level["node"], tree.children[at]):
                place[cell, 2 * node], place[cell, 2 * node + 1] = children
    shared = spark.sparkContext.broadcast(tree)

    def boxes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = _matrix(pdf["f"])
                leaf = shared.value.leaf_of(x)
                order = np.argsort(leaf, kind="stable")
                cells, starts = np.unique(leaf[order], return_index=True)
                yield pd.DataFrame({"cell": cells, "low": list(np.fmin.reduceat(x[order], starts)), "high": list(np.fmax.reduceat(x[order], starts))})

    found = points.select("f").mapInPandas(boxes, "cell long, low array<double>, high array<double>").groupBy("cell").agg(
        F.array(*[F.min(F.col("low")[j]) for j in range(width)]).alias("low"),
        F.array(*[F.max(F.col("high")[j]) for j in range(width)]).alias("high")).toPandas()
    tree.fit_boxes(found["cell"].to_numpy(), _matrix(found["low"]), _matrix(found["high"]))
    return tree


def _probe(requests: DataFrame, members: DataFrame, k: int, block: int) -> DataFrame:
    """requests: (qid, qf, cell); members: (nid, nf, cell). Returns (qid, dist, nid) <= k per query and block."""
    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(name))

    both = blocks(requests, "nq").join(blocks(members, "nm"), "cell").checkpoint(eager=True)   # a row per leaf
    req = (requests.join(both, "cell")
           .withColumn("qblock", F.pmod(F.xxhash64("qid"), F.col("nq")).cast("int"))
           .withColumn("mblock", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)))
           .select("cell", "mblock", "qblock", "qid", "qf"))
    mem = (members.join(both, "cell")
           .withColumn("mblock", F.pmod(F.xxhash64("nid"), F.col("nm")).cast("int"))
           .withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
           .select("cell", "mblock", "qblock", "nid", "nf"))

    def nearest(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if q.empty or m.empty:
            return pd.DataFrame({"qid": [], "dist": [], "nid": []})
        Q = np.stack(q["qf"].to_numpy()).astype(float)
        M = np.stack(m["nf"].to_numpy()).astype(float)
        qids, nids = q["qid"].to_numpy(), m["nid"].to_numpy()
        kk = min(2 * k, len(nids))      # select a margin by the fast form, re-rank exactly below
        out_q, out_d, out_n = [], [], []
        m2 = (M * M).sum(axis=1)
        for s in range(0, len(Q), 512):
            Qs = Q[s:s + 512]
            d2 = (Qs * Qs).sum(axis=1)[:, None] + m2[None, :] - 2.0 * Qs @ M.T
            d2 = np.maximum(d2, 0.0)
            d2[qids[s:s + 512][:, None] == nids[None, :]] = np.inf          # never its own neighbour
            idx = np.argpartition(d2, kk - 1, axis=1)[:, :kk] if kk < len(nids) else np.tile(np.arange(len(nids)), (len(Qs), 1))
            rows = np.repeat(np.arange(len(Qs)), idx.shape[1])
            cols = idx.ravel()
            dd = d2[rows, cols]
            ok = np.isfinite(dd)
            # exact distances for the kept pairs, then the k nearest per query
            part = pd.DataFrame({"qid": qids[s:s + 512][rows[ok]], "nid": nids[cols[ok]],
                                 "dist": np.sqrt(((Qs[rows[ok]] - M[cols[ok]]) ** 2).sum(axis=1))})
            part = part.sort_values(["qid", "dist", "nid"]).groupby("qid", sort=False).head(k)
            out_q.append(part["qid"].to_numpy())
            out_n.append(part["nid"].to_numpy())
            out_d.append(part["dist"].to_numpy())
        return pd.DataFrame({"qid": np.concatenate(out_q), "dist": np.concatenate(out_d), "nid": np.concatenate(out_n)})

    return (req.groupBy("cell", "mblock", "qblock")
            .cogroup(mem.groupBy("cell", "mblock", "qblock"))
            .applyInPandas(nearest, HIT_SCHEMA))


def _best_k(hits: DataFrame, k: int) -> DataFrame:
    """Per query the k nearest (dist, nid), one shuffle; each list is bounded by k x probed blocks."""
    return hits.groupBy("qid").agg(
        F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct("dist", "nid")))), 1, k).alias("knn"))


def exact_knn(points: DataFrame, k: int, seed: int = C.SEED, block: int | None = None,
              first_probes: int | None = None) -> DataFrame:
    """points: (id long, f array<double>) with distinct ``f``. Returns (id, knn array<struct<dist, nid>>)."""
    spark = points.sparkSession
    block = block or C.KNN_BLOCK
    first_probes = first_probes or C.KNN_FIRST_PROBES
    pts = points.checkpoint(eager=True)
    n = pts.count()
    if n <= block:
        # one bounded block holds every point: a single probe is already exact
        one = pts.select(F.col("id").alias("qid"), F.col("f").alias("qf"), F.lit(0).cast("long").alias("cell"))
        mem = pts.select(F.col("id").alias("nid"), F.col("f").alias("nf"), F.lit(0).cast("long").alias("cell"))
        return _best_k(_probe(one, mem, k, block), k).select(F.col("qid").alias("id"), "knn")
    shared = spark.sparkContext.broadcast(grow_cells(pts, block, seed))
    req_schema = "qid long, qf array<double>, cell long"

    def assign(frames):
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(cell=shared.value.leaf_of(_matrix(pdf["f"])))

    placed = pts.select("id", "f").mapInPandas(assign, "id long, f array<double>, cell long").checkpoint(eager=True)
    members = placed.select(F.col("id").alias("nid"), F.col("f").alias("nf"), "cell")

    def first_round(frames):
        for pdf in frames:
            x, ids = (_matrix(pdf["f"]), pdf["id"].to_numpy()) if len(pdf) else (np.zeros((0, 1)), pdf["id"].to_numpy())
            for s in range(0, len(x), 256):
                near = shared.value.near_leaves(x[s:s + 256], first_probes)
                q, at = np.nonzero(near >= 0)
                yield pd.DataFrame({"qid": ids[s:s + 256][q], "qf": list(x[s:s + 256][q]), "cell": near[q, at]})

    r1 = _best_k(_probe(pts.select("id", "f").mapInPandas(first_round, req_schema).checkpoint(eager=True), members, k, block), k).checkpoint(eager=True)

    def second_round(frames):
        for pdf in frames:
            x, ids, rks = (_matrix(pdf["f"]), pdf["id"].to_numpy(), pdf["rk"].to_numpy()) if len(pdf) else (np.zeros((0, 1)), None, None)
            for s in range(0, len(x), 256):
                part = x[s:s + 256]
                probed = shared.value.near_leaves(part, first_probes)
                for row, leaf in shared.value.reachable(part, rks[s:s + 256]):
                    new = (probed[row] != leaf[:, None]).all(axis=1)
                    if new.any():
                        yield pd.DataFrame({"qid": ids[s:s + 256][row[new]], "qf": list(part[row[new]]), "cell": leaf[new]})

    kth = F.when(F.size("knn") >= k, F.element_at("knn", k)["dist"]).otherwise(F.lit(float("inf")))
    with_rk = pts.select("id", "f").join(r1.select(F.col("qid").alias("id"), kth.alias("rk")), "id", "left") \
        .fillna(float("inf"), subset=["rk"])
    hits2 = _probe(with_rk.mapInPandas(second_round, req_schema).checkpoint(eager=True), members, k, block)
    r1_hits = r1.select("qid", F.explode("knn").alias("h")).select("qid", "h.dist", "h.nid")
    final = _best_k(r1_hits.unionByName(hits2), k)
    return final.select(F.col("qid").alias("id"), "knn")


def exact_knn_with_duplicates(rows: DataFrame, k: int, seed: int = C.SEED) -> DataFrame:
    """rows: (id long, f array<double>), duplicates allowed. Returns (id, nb array<array<double>>):
    the feature vectors of each row's k nearest other rows (its equal copies first, at distance 0)."""
    distinct = rows.groupBy("f").agg(F.min("id").alias("vid"), F.count(F.lit(1)).alias("mult")).checkpoint(eager=True)
    knn = exact_knn(distinct.select(F.col("vid").alias("id"), "f"), k, seed)
    info = distinct.select(F.col("vid").alias("nid"), F.col("f").alias("nf"), F.col("mult").alias("nmult"))
    nb = (knn.select("id", F.posexplode("knn").alias("pos", "h"))
          .select("id", "pos", F.col("h.nid").alias("nid"))
          .join(info, "nid")
          .groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "nf", "nmult"))).alias("__n")))
    # expand each distinct neighbour by its multiplicity (k of them at most), after the row's own copies
    per_vid = (distinct.join(nb, distinct.vid == nb.id, "left")
               .select("vid", "f", "mult",
                       F.coalesce(F.flatten(F.transform("__n", lambda s: F.array_repeat(s["nf"], F.least(F.lit(k).cast("long"), s["nmult"]).cast("int")))),
                                  F.array().cast("array<array<double>>")).alias("__others")))
    own = F.array_repeat(F.col("f"), F.least(F.lit(k), F.col("mult") - 1).cast("int"))
    per_vid = per_vid.select("f", F.slice(F.concat(own, "__others"), 1, k).alias("nb"))
    return rows.join(per_vid, "f").select("id", "nb")
