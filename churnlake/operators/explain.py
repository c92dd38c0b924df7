"""Explainability: importances, linear SHAP, path-dependent TreeSHAP, driver reports.

TreeSHAP (Lundberg, Erion and Lee, "Consistent individualized feature
attribution for tree ensembles", 2018, Algorithm 2) runs in ``mapInArrow``:
the fitted trees are small arrays (``operators/boosting``) and are broadcast; tasks
explain chunks of rows by groups of trees, so all rows are explained, not a sample. A
tree is cut into pieces whose values depend on few conditions: the polynomials of
Algorithm 2 are carried down a piece at Gauss points once for every pattern of these,
and a row looks its pattern up. Trees with too many features on a path are gone down by the rows themselves. Linear
SHAP, summaries and per-row drivers are plain DataFrame expressions (unpivot,
group-by, ``row_number`` per customer).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.functions.tables import small_table
from churnlake.operators.boosting import TreesModel
from churnlake.session import scratch_path

# ----------------------------------------------------------------------------- trees


def tree_ensemble(model: PipelineModel) -> tuple[list[dict], list[float], str]:
    """Trees as arrays, their weights and the output space ('margin' or 'probability')."""
    clf = model.stages[-1]
    if not isinstance(clf, TreesModel):
        raise TypeError(f"not a tree model: {clf.__class__.__name__}")
    if clf.getOrDefault("output") == "share":
        return clf.trees, [1.0 / len(clf.trees)] * len(clf.trees), "probability"
    start = {"feature": np.array([-1]), "threshold": np.zeros(1), "left": np.array([-1]), "right": np.array([-1]),
             "cover": np.ones(1), "value": np.array([clf.getOrDefault("base")])}
    return [start, *clf.trees], [1.0] * (1 + len(clf.trees)), "margin"


def expected_value(tree: dict) -> float:
    leaves = tree["left"] < 0
    return float((tree["cover"][leaves] * tree["value"][leaves]).sum() / tree["cover"][0])


def tree_shap_batch(tree: dict, X: np.ndarray, phi: np.ndarray, scale: float = 1.0) -> None:
    """Adds the path-dependent SHAP values of one tree for all rows of ``X`` into ``phi``.

    A leaf gives a feature on its path value * (o - z) * the integral over t in (0, 1) of the product of t * o + (1 - t) * z
    over the other features on the path; z is the feature's product of cover ratios, o whether the row's value
    stays on the path. The product is a polynomial, so Gauss-Legendre points give its integral exactly. It is carried
    down the tree at these points for all rows, its sums over leaves up again: a few operations per node, not per leaf and feature."""
    feat, thr, left, right, cover, value = (tree[k] for k in ("feature", "threshold", "left", "right", "cover", "value"))
    widest, todo = 0, [(0, frozenset())]
    while todo:
        j, on = todo.pop()
        widest = max(widest, len(on))
        if left[j] >= 0:
            todo += [(left[j], on | {feat[j]}), (right[j], on | {feat[j]})]
    if not widest:
        return
    points, weights = _gauss(widest, scale)
    for a in range(0, len(X), SHAP_BATCH):
        x = np.ascontiguousarray(X[a : a + SHAP_BATCH].T)
        _leaves_below(tree, lambda j: x[feat[j]] <= thr[j], points, weights, 0, np.ones((len(points), x.shape[1])), {}, phi[a : a + SHAP_BATCH].T)


def _gauss(widest: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights in (0, 1) that are exact for paths of up to ``widest`` different features."""
    points, weights = np.polynomial.legendre.leggauss((widest + 1) // 2)
    return ((points + 1) / 2)[:, None], weights / 2 * scale


def _factor(points: np.ndarray, on: np.ndarray, z: float) -> tuple[np.ndarray, np.ndarray]:
    """t * o + (1 - t) * z, and the same to divide by: where it is 0 so are all products with it."""
    factor = np.where(on, points + (1 - points) * z, (1 - points) * z)
    return factor, factor if z > 0 else np.where(factor == 0, 1.0, factor)


def _leaves_below(tree: dict, goes_left, points, weights, j, product, path: dict, out):
    """Adds to ``out`` what the leaves below node ``j`` give the features split by there; returns their sum of products."""
    feat, left, right, cover = tree["feature"], tree["left"], tree["right"], tree["cover"]
    if left[j] < 0:
        return tree["value"][j] * product
    f = feat[j]
    o_before, z_before, before = path.get(f, (None, 1.0, None))
    rest = product if before is None else product / before
    to_left, total = goes_left(j), 0.0
    for child, goes in ((left[j], to_left), (right[j], ~to_left)):
        o = goes if before is None else goes & o_before
        z = z_before * cover[child] / cover[j]
        factor, safe = _factor(points, o, z)
        below = _leaves_below(tree, goes_left, points, weights, child, rest * factor, {**path, f: (o, z, safe)}, out)
        out[f] += (o - z) * (weights @ (below / safe))
        if before is not None:  # these leaves count by the condition nearest to them only
            out[f] -= (o_before - z_before) * (weights @ (below / before))
        total = total + below
    return total


#: Rows that go down a tree together; the least and the most rows of a block of rows to explain, and the rows of a task.
SHAP_BATCH = 2048
SHAP_ROWS = (500, 8192)
SHAP_CHUNK = 500_000
#: Leaves of up to so many different features on their path are explained from a table of 2^d rows.
PATTERN_FEATURES = 8
#: Rows of a task for each pattern of a piece and, at least, for each piece of a tree (fewer go down the tree themselves),
#: patterns that a single leaf may have, values of tables that are looked up together.
ROWS_PER_PATTERN = 24
ROWS_PER_PIECE = 20
LEAF_PATTERNS = 1 << 13
HELD_VALUES = 1 << 18


def leaf_paths(tree: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]]:
    """Per leaf: the features on its path, the interval (low, high] that the path leaves of each, the share of rows
    that an unknown value of it would send the leaf's way (product of cover ratios), and the leaf's value."""
    feat, thr, left, right, cover, value = (tree[k] for k in ("feature", "threshold", "left", "right", "cover", "value"))
    found, todo = [], [(0, {})]
    while todo:
        j, path = todo.pop()
        if left[j] < 0:
            parts = np.array([path[f] for f in path], float).reshape(-1, 3)
            found.append((np.array(list(path), np.int64), parts[:, 0], parts[:, 1], parts[:, 2], float(value[j])))
            continue
        low, high, share = path.get(feat[j], (-np.inf, np.inf, 1.0))
        todo.append((right[j], {**path, feat[j]: (max(low, thr[j]), high, share * cover[right[j]] / cover[j])}))
        todo.append((left[j], {**path, feat[j]: (low, min(high, thr[j]), share * cover[left[j]] / cover[j])}))
    return found


def pattern_table(share: np.ndarray, value: float) -> np.ndarray:
    """SHAP values that a leaf gives its d features, for every pattern of features whose value stays on the path.

    Row p holds the pattern with bit i set if feature i does. The weights of all orders of the features are the
    coefficients of a product of d - 1 linear terms, worked out for all patterns at once."""
    d = len(share)
    on = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(float)
    weight = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
    out = np.empty((1 << d, d))
    for i in range(d):
        terms = np.zeros((1 << d, d))
        terms[:, 0] = 1.0
        for n, j in enumerate(j for j in range(d) if j != i):
            terms[:, 1 : n + 2] = terms[:, 1 : n + 2] * share[j] + terms[:, : n + 1] * on[:, j : j + 1]
            terms[:, 0] *= share[j]
        out[:, i] = value * (on[:, i] - share[i]) * (terms @ weight)
    return out


def prepared_trees(trees: Sequence[dict]) -> list:
    """For each tree the paths of its leaves with their tables, or the tree itself where a path has too many features."""
    out: list = []
    for tree in trees:
        paths = leaf_paths(tree)
        if max(len(p[0]) for p in paths) > PATTERN_FEATURES:
            out.append(tree)
        else:
            out.append([(f, low, high, pattern_table(share, value)) for f, low, high, share, value in paths if len(f)])
    return out


def add_shap(prepared, X: np.ndarray, phi: np.ndarray, scale: float = 1.0) -> None:
    """SHAP values of one prepared tree for all rows of ``X``: a row's pattern at a leaf looks its values up."""
    if isinstance(prepared, dict):
        tree_shap_batch(prepared, X, phi, scale)
        return
    columns = X.T
    for features, low, high, table in prepared:
        pattern = np.zeros(len(X), np.int64)
        for i, f in enumerate(features.tolist()):
            x = columns[f]
            pattern |= ((x > low[i]) & (x <= high[i])).astype(np.int64) << i
        got = table[pattern]
        for i, f in enumerate(features.tolist()):
            phi[:, f] += scale * got[:, i]


def pieces(tree: dict, cuts: np.ndarray, most: int) -> Iterator[tuple[int, dict, dict]] | None:
    """Cuts a tree into subtrees whose values have at most ``most`` patterns (single leaves may have LEAF_PATTERNS): (node, path to it
    {feature: (low, high, share)}, {feature: cuts below}). Rows are known by the codes of their values: one goes left at a node if its
    code is at most the node's cut. None if a leaf has more patterns."""
    feat, left, right, cover = (tree[k] for k in ("feature", "left", "right", "cover"))
    below: list[dict] = [{}] * len(feat)
    order, todo = [], [0]
    while todo:
        order.append(j := todo.pop())
        todo += [left[j], right[j]] if left[j] >= 0 else []
    for j in reversed(order):
        if left[j] >= 0:
            own = {f: set(v) for f, v in below[left[j]].items()}
            for f, v in (*below[right[j]].items(), (int(feat[j]), {int(cuts[j])})):
                own[f] = own.get(f, set()) | v
            below[j] = own
    found, todo = [], [(0, {})]
    while todo:
        j, path = todo.pop()
        patterns = math.prod([len(below[j].get(f, ())) + 2 for f in path] + [len(v) + 1 for f, v in below[j].items() if f not in path])
        if patterns <= (most if left[j] >= 0 else max(most, LEAF_PATTERNS)):
            if path or left[j] >= 0:
                found.append((j, path, {f: sorted(v) for f, v in below[j].items()}))
        elif left[j] < 0:
            return None
        else:
            f = int(feat[j])
            low, high, share = path.get(f, (-1, math.inf, 1.0))
            todo.append((right[j], {**path, f: (max(low, cuts[j]), high, share * cover[right[j]] / cover[j])}))
            todo.append((left[j], {**path, f: (low, min(high, cuts[j]), share * cover[left[j]] / cover[j])}))
    return found


def piece_table(tree: dict, cuts: np.ndarray, node: int, path: dict, below: dict, codes: Sequence[int], scale: float) -> tuple[list, np.ndarray, np.ndarray]:
    """A piece's features with tables from a code (there are ``codes[f]`` of feature f) to a part of a pattern's number, the
    pieces' features as an array, and SHAP values of the leaves of the piece by feature and pattern.

    A feature on the path is off it, or in one of the intervals between the cuts below; any other is in an interval."""
    lookups, on, value, step = [], {}, {}, 1
    features = [*path, *[f for f in below if f not in path]]
    sizes = [len(below.get(f, ())) + (2 if f in path else 1) for f in features]
    number = np.arange(math.prod(sizes))
    for f, size in zip(features, sizes):
        ends = np.array(below.get(f, ()), np.int64)
        code = np.arange(codes[f])
        state, own = np.searchsorted(ends, code, "left"), number // step % size
        if f in path:
            low, high, _ = path[f]
            state, on[f], own = np.where((code > low) & (code <= high), state + 1, 0), own > 0, np.maximum(own - 1, 0)
        value[f] = np.append(ends, ends[-1] + 1 if len(ends) else 0)[own]
        lookups.append((f, state * step))
        step *= size
    widest, todo = 0, [(node, frozenset(path))]
    while todo:
        j, seen = todo.pop()
        widest = max(widest, len(seen))
        if tree["left"][j] >= 0:
            todo += [(c, seen | {tree["feature"][j]}) for c in (tree["left"][j], tree["right"][j])]
    points, weights = _gauss(widest, scale)
    table = np.zeros((len(features), len(number)))
    for a in range(0, len(number), SHAP_BATCH):
        part = slice(a, a + SHAP_BATCH)
        out = {f: np.zeros(len(number[part])) for f in features}
        start, product = {}, np.ones((len(points), len(number[part])))
        for f, (_, _, z) in path.items():
            factor, safe = _factor(points, on[f][part], z)
            start[f] = on[f][part], z, safe
            product = product * factor
        total = _leaves_below(tree, lambda j: value[tree["feature"][j]][part] <= cuts[j], points, weights, node, product, start, out)
        for f, (o, z, safe) in start.items():
            out[f] += (o - z) * (weights @ (total / safe))
        for i, f in enumerate(features):
            table[i, part] = out[f]
    return lookups, np.array(features), table


def add_shap_by_pieces(trees: Sequence[dict], X: np.ndarray, phi: np.ndarray, weights: Sequence[float]) -> None:
    """Adds the SHAP values of some trees for all rows of ``X`` (a line of values per feature) to ``phi`` (a line per feature).

    The values of a piece of a tree (``pieces``) depend on a few conditions: they are worked out once for every pattern of these, rows look
    theirs up. Pieces have the fewer patterns the fewer rows there are."""
    inner = [t["left"] >= 0 for t in trees]
    cut_at = [np.unique(np.concatenate([t["threshold"][i & (t["feature"] == f)] for t, i in zip(trees, inner)] or [[]])) for f in range(len(X))]
    narrow = np.uint8 if max(map(len, cut_at), default=0) < 256 else np.uint32
    codes = np.array([np.searchsorted(c, x, "left").astype(narrow) for c, x in zip(cut_at, X)]).reshape(len(X), -1)
    rows = codes.shape[1]
    most = min(max(rows // ROWS_PER_PATTERN, 16), LEAF_PATTERNS)
    held: list = []

    def look_up() -> None:
        for a in range(0, rows, SHAP_BATCH):
            some, to = codes[:, a : a + SHAP_BATCH], phi[:, a : a + SHAP_BATCH]
            for lookups, features, table in held:
                pattern = np.zeros(some.shape[1], np.int64)
                for f, part in lookups:
                    pattern += part.take(some[f])
                for f, values in zip(features.tolist(), table):
                    to[f] += values.take(pattern)
        held.clear()

    for tree, i, weight in zip(trees, inner, weights):
        cuts = np.full(len(i), -1)
        for f in np.unique(tree["feature"][i]).tolist():
            at = i & (tree["feature"] == f)
            cuts[at] = np.searchsorted(cut_at[f], tree["threshold"][at])
        found = pieces(tree, cuts, most)
        if found is None or rows < ROWS_PER_PIECE * len(found):
            tree_shap_batch(tree, X.T, phi.T, weight)
            continue
        for node, path, below in found:
            held.append(piece_table(tree, cuts, node, path, below, [len(c) + 1 for c in cut_at], weight))
            if sum(t.size for *_, t in held) > HELD_VALUES:
                look_up()
    look_up()


def tree_predict_batch(tree: dict, X: np.ndarray) -> np.ndarray:
    idx = np.zeros(X.shape[0], dtype=int)
    for _ in range(len(tree["feature"])):
        internal = tree["left"][idx] >= 0
        if not internal.any():
            break
        f = np.where(internal, tree["feature"][idx], 0)
        go_left = X[np.arange(X.shape[0]), f] <= tree["threshold"][idx]
        idx = np.where(internal, np.where(go_left, tree["left"][idx], tree["right"][idx]), idx)
    return tree["value"][idx]


def tree_shap_frame(model: PipelineModel, df: DataFrame, key: str = C.ID,
                    names: Sequence[str] = C.ML_FEATURES) -> DataFrame:
    """Long rows (key, feature, feature_value, shap_value) + per-row base/output for every input row.

    Rows are packed into blocks and written once. A task explains all rows of a chunk of blocks by a group of the trees, so that what it works
    out for a tree serves many rows; the groups' values of a block are then added up."""
    trees, weights, _space = tree_ensemble(model)
    base = float(sum(w * expected_value(t) for t, w in zip(trees, weights)))
    spark, names = df.sparkSession, list(names)
    m, cores = len(names), spark.sparkContext.defaultParallelism
    # one copy per executor (not per task closure); 300 trees x 127 nodes is ~1 MB
    shipped = spark.sparkContext.broadcast((trees, weights))
    n = df.count()
    chunks = max(1, -(-n // SHAP_CHUNK))
    groups = max(1, min(len(trees), -(-2 * cores // chunks)))
    # a row costs far more than its bytes tell: few rows in one small file still go to all cores
    size = max(SHAP_ROWS[0], min(SHAP_ROWS[1], -(-n // (2 * cores))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                some = batch.slice(a, size)
                x = np.ascontiguousarray(np.asarray(some.column(1).flatten(), float).reshape(some.num_rows, m).T)
                row = [part * (1 << 32) + number, part % chunks, some.column(0).to_pylist(), x.tobytes()]
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row, [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()])], ["block", "chunk", "keys", "x"])
                number += 1

    path = scratch_path(spark, "shap-rows")
    PipelineModel(stages=model.stages[:-1]).transform(df).select(F.col(key).cast("long").alias("key"), vector_to_array("features").alias("x")) \
        .repartition(chunks * max(1, -(-n // (chunks * 8 * SHAP_ROWS[1])))).mapInArrow(pack, "block long, chunk int, keys array<long>, x binary").write.parquet(path)
    blocks = spark.read.schema("block long, chunk int, keys array<long>, x binary").parquet(path)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr, ws = shipped.value
        now, held = None, []

        def values() -> Iterator[pa.RecordBatch]:
            group = now % groups
            own, w = tr[group::groups], ws[group::groups]
            X = np.concatenate([np.frombuffer(r["x"]).reshape(m, -1) for r in held], axis=1)
            phi, out = np.zeros(X.shape), np.zeros(X.shape[1])
            add_shap_by_pieces(own, X, phi, w)
            for t, v in zip(own, w):
                out += v * tree_predict_batch(t, X.T)
            at = 0
            for r in held:
                end = at + len(r["keys"])
                row = [r["block"], group, phi[:, at:end].tobytes(), out[at:end].tobytes(), *((r["keys"], r["x"]) if group == 0 else (None, None))]
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds)], ["block", "group", "phi", "output", "keys", "x"])
                at = end
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if now not in (None, row["unit"]):
                    yield from values()
                now = row["unit"]
                held.append(row)
        if now is not None:
            yield from values()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def long() -> pa.RecordBatch:
            rows = len(now["keys"])
            keys = pa.array(now["keys"], pa.int64()).take(pa.array(np.repeat(np.arange(rows), m)))
            columns = [keys, pa.array(np.tile(np.arange(m, dtype=np.int32), rows)), *[pa.array(v.reshape(m, rows).T.ravel()) for v in (np.frombuffer(now["x"]), now["phi"])], pa.array(np.repeat(now["output"], m))]
            return pa.record_batch(columns, ["key", "fidx", "feature_value", "shap_value", "model_output"])

        for batch in batches:
            for row in batch.to_pylist():
                phi, output = np.frombuffer(row["phi"]), np.frombuffer(row["output"])
                if now is not None and now["block"] == row["block"]:
                    now["phi"] = now["phi"] + phi
                    now["output"] = now["output"] + output
                    continue
                if now is not None:
                    yield long()
                now = {**row, "phi": phi, "output": output}
        if now is not None:
            yield long()

    unit = F.explode(F.sequence(F.col("chunk") * groups, F.col("chunk") * groups + groups - 1)).alias("unit")
    parts = max(1, min(-(-n // size), max(2 * cores, -(-n // (8 * size)))))
    out = blocks.select(unit, "block", "keys", "x").repartitionById(chunks * groups, "unit").sortWithinPartitions("unit") \
        .mapInArrow(explain, "block long, group int, phi binary, output binary, keys array<long>, x binary") \
        .repartition(parts, "block").sortWithinPartitions("block", "group") \
        .mapInArrow(add_up, "key long, fidx int, feature_value double, shap_value double, model_output double")
    fname = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("fidx") + 1)
    return out.select(F.col("key").alias(key), fname.alias("feature"), "feature_value", "shap_value",
                      F.lit(base).alias("base_value"), "model_output")


# ----------------------------------------------------------------------------- linear
def linear_shap(df: DataFrame, coefs: Sequence[tuple[str, float]], key: str = C.ID) -> DataFrame:
    """coef * (x - mean(x)) for each feature; the background is the same data (one mean aggregate)."""
    return df.select(key, F.inline(_linear_items(df, coefs)))


def linear_row_drivers(df: DataFrame, coefs: Sequence[tuple[str, float]], key: str = C.ID, top: int = C.ROW_DRIVERS_TOP) -> DataFrame:
    """``row_drivers`` of ``linear_shap`` inside each row: an array is sorted and cut, nothing is shuffled."""
    items = F.transform(_linear_items(df, coefs), lambda s: F.struct(
        (-F.abs(s["shap_value"])).alias("order"), s["pos"].alias("pos"), s["feature"].alias("feature"),
        s["feature_value"].alias("feature_value"), s["shap_value"].alias("shap_value")))
    r = df.select(key, F.posexplode(F.slice(F.array_sort(items), 1, top)).alias("p", "d"))
    return r.select(key, (F.col("p") + 1).alias("rank"), "d.feature", F.round("d.feature_value", 6).alias("feature_value"),
                    F.round("d.shap_value", 6).alias("shap_value"), direction(F.col("d.shap_value")).alias("direction"))


def _linear_items(df: DataFrame, coefs: Sequence[tuple[str, float]]) -> Column:
    cols = [c for c, _ in coefs]
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    items = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("feature_value"),
                      (F.lit(float(b)) * (F.col(c).cast("double") - F.lit(float(means[f"m{i}"])))).alias("shap_value"))
             for i, (c, b) in enumerate(coefs)]
    return F.array(*items)


def linear_model_shap(model: PipelineModel, df: DataFrame, key: str = C.ID, names: Sequence[str] = C.ML_FEATURES) -> DataFrame:
    """SHAP of a fitted linear model's margin, in the form of ``tree_shap_frame``: coefficient times the
    scaled feature's distance from its mean over ``df`` (one aggregate)."""
    clf = model.stages[-1]
    coefs, intercept = [float(v) for v in clf.coefficients.toArray()], float(clf.intercept)
    x = PipelineModel(stages=model.stages[:-1]).transform(df).select(F.col(key).cast("long").alias(key), vector_to_array("features").alias("x"))
    means = x.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(coefs))]).first()
    mean = [float(means[f"m{i}"] or 0.0) for i in range(len(coefs))]
    base = intercept + sum(c * m for c, m in zip(coefs, mean))
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.col("x")[i].alias("feature_value"),
                               (F.lit(c) * (F.col("x")[i] - F.lit(m))).alias("shap_value"))
                      for i, (n, c, m) in enumerate(zip(names, coefs, mean))])
    output = F.lit(intercept) + sum((F.lit(c) * F.col("x")[i] for i, c in enumerate(coefs)), F.lit(0.0))
    return x.withColumn("model_output", output).select(key, F.inline(items), F.lit(base).alias("base_value"), "model_output") \
        .select(key, "feature", "feature_value", "shap_value", "base_value", "model_output")


def explain_model(model: PipelineModel, df: DataFrame, key: str = C.ID, names: Sequence[str] = C.ML_FEATURES) -> DataFrame:
    """SHAP rows of whichever model is given: linear by its coefficients, trees and ensembles by TreeSHAP."""
    if hasattr(model.stages[-1], "coefficients"):
        return linear_model_shap(model, df, key, names)
    return tree_shap_frame(model, df, key, names)


def additivity_gap(long: DataFrame, key: str = C.ID) -> DataFrame:
    """Per row |base + sum of SHAP values - model output|, which is 0 but for rounding."""
    g = long.groupBy(key).agg(F.sum("shap_value").alias("s"), F.first("base_value").alias("b"), F.first("model_output").alias("o"))
    return g.select(key, F.abs(F.col("s") + F.col("b") - F.col("o")).alias("gap"))


def direction(shap: Column) -> Column:
    return F.when(shap > 0, F.lit(C.DIRECTION_UP)).otherwise(F.lit(C.DIRECTION_DOWN))


def shap_summary(long: DataFrame, top: int = C.SHAP_TOP) -> DataFrame:
    """mean |SHAP| per feature, ranked (ties by feature name), first ``top``."""
    s = long.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
    ranked = s.orderBy(F.col("mean_abs_shap").desc(), F.col("feature")).limit(top)
    w = Window.orderBy(F.col("mean_abs_shap").desc(), F.col("feature"))  # over <= top rows only
    return ranked.withColumn("rank", F.row_number().over(w)).select("feature", F.round("mean_abs_shap", 6).alias("mean_abs_shap"), "rank")


def row_drivers(long: DataFrame, key: str = C.ID, top: int = C.ROW_DRIVERS_TOP) -> DataFrame:
    """Per row the ``top`` features by |SHAP| (bounded window: one partition per row key)."""
    order = [F.abs("shap_value").desc()] + ([F.col("pos")] if "pos" in long.columns else [F.col("feature")])
    w = Window.partitionBy(key).orderBy(*order)
    r = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return r.select(key, "rank", "feature", F.round("feature_value", 6).alias("feature_value"),
                    F.round("shap_value", 6).alias("shap_value"), direction(F.col("shap_value")).alias("direction"))


def driver_report(summary: DataFrame, top: int = C.DRIVER_REPORT_TOP) -> DataFrame:
    narr = small_table(summary.sparkSession, list(C.DRIVER_NARRATIVES), "feature string, narrative string")
    t = summary.where(F.col("rank") <= top)
    return t.join(F.broadcast(narr), "feature", "left").select(
        "rank", "feature", "mean_abs_shap", F.coalesce("narrative", F.lit(C.DEFAULT_NARRATIVE)).alias("narrative"))


def importance_frame(spark, pairs: Sequence[tuple[str, float]]) -> DataFrame:
    """(feature, importance, importance_pct) sorted descending; percent of the total, 2 digits."""
    df = spark.createDataFrame([(f, float(v)) for f, v in pairs], "feature string, importance double")
    tot = df.agg(F.sum("importance").alias("__t"))
    return df.crossJoin(F.broadcast(tot)).select(
        "feature", "importance", F.round(F.try_divide(F.col("importance") * 100.0, F.col("__t")), 2).alias("importance_pct")) \
        .orderBy(F.desc("importance"), "feature")


def family(feature: Column) -> Column:
    return (F.when(feature.contains("Risk") | feature.contains("Churn"), "Risk")
            .when(feature.contains("Engagement") | feature.contains("Loyalty") | feature.contains("Activity"), "Engagement")
            .otherwise("Raw"))


def importance_top(imp: DataFrame, top: int = C.IMPORTANCE_TOP) -> DataFrame:
    return imp.orderBy(F.col("importance").desc(), F.col("feature")).limit(top) \
        .withColumn("family", family(F.col("feature")))


def importance_by_type(imp: DataFrame) -> DataFrame:
    types = small_table(imp.sparkSession, list(C.FEATURE_TYPES), "feature string, type string")
    j = imp.join(F.broadcast(types), "feature", "left").withColumn("type", F.coalesce("type", F.lit("Other")))
    return j.groupBy("type").agg(F.round(F.sum("importance_pct"), 2).alias("importance_pct"))
