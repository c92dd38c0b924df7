"""Properties of the rows-only ML pieces: split shares, SMOTE, TreeSHAP, AUC, persistence."""

import itertools

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.operators import explain as X
from churnlake.operators import ml as ML
from churnlake.operators.smote import smote
from churnlake.plans import stages
from tests.conftest import SF_SMALL
from tests.shap_reference import tree_predict, tree_shap


def test_split_class_shares_are_exact(spark):
    s = ML.stratified_split(stages.features(spark, SF_SMALL))
    for r in s.groupBy("Exited").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r["t"] == ML.test_quota(r["n"])


def _points(spark, minority, majority, dim=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, 1, [float(v) for v in rng.normal(size=dim)]) for i in range(minority)]
    rows += [(1000 + i, 0, [float(v) for v in rng.normal(size=dim) + 3]) for i in range(majority)]
    df = spark.createDataFrame(rows, "CustomerId long, Exited int, f array<double>")
    return df.select("CustomerId", "Exited", array_to_vector("f").alias("features")), rows


@pytest.mark.parametrize("minority,majority", [(5, 40), (30, 100)])
def test_smote_count_and_segments(spark, minority, majority):
    df, rows = _points(spark, minority, majority)
    syn = smote(df, k=5).collect()
    assert len(syn) == int(C.SMOTE_RATIO * majority) - minority
    mins = {i: np.array(f) for i, lab, f in rows if lab == 1}
    for r in syn:
        assert r["CustomerId"] is None  # a synthetic row is no customer
        p = r["features"].toArray()
        ok = False
        for base, other in itertools.permutations(mins.values(), 2):
            d = other - base
            if not d.any():
                continue
            u = float(np.dot(p - base, d) / np.dot(d, d))
            if -1e-9 <= u <= 1 + 1e-9 and np.allclose(base + u * d, p, atol=1e-9):
                ok = True
                break
        assert ok, "synthetic point is not on a segment between two minority rows"


def _brute_shapley(tree, x, m):
    """Exact Shapley values of the path-dependent conditional expectation (exponential; tiny trees)."""
    def value(S):
        def ev(j):
            if tree["left"][j] < 0:
                return tree["value"][j]
            f = tree["feature"][j]
            if f in S:
                return ev(tree["left"][j] if x[f] <= tree["threshold"][j] else tree["right"][j])
            c = tree["cover"]
            return (c[tree["left"][j]] * ev(tree["left"][j]) + c[tree["right"][j]] * ev(tree["right"][j])) / c[j]
        return ev(0)
    from math import factorial
    phi = np.zeros(m)
    for i in range(m):
        others = [k for k in range(m) if k != i]
        for size in range(m):
            for S in itertools.combinations(others, size):
                w = factorial(size) * factorial(m - size - 1) / factorial(m)
                phi[i] += w * (value(set(S) | {i}) - value(set(S)))
    return phi


def test_tree_shap_equals_brute_force_shapley():
    # depth-3 tree that splits twice on feature 0
    tree = {"feature": np.array([0, 1, -1, -1, 0, -1, -1]),
            "threshold": np.array([0.5, 0.2, 0, 0, 0.8, 0, 0]),
            "left": np.array([1, 2, -1, -1, 5, -1, -1]), "right": np.array([4, 3, -1, -1, 6, -1, -1]),
            "cover": np.array([100.0, 60, 20, 40, 40, 30, 10]), "value": np.array([0, 0, 1.0, -2.0, 0, 3.0, 5.0])}
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.uniform(size=3)
        phi = np.zeros(3)
        tree_shap(tree, x, phi)
        assert np.allclose(phi, _brute_shapley(tree, x, 3), atol=1e-12)
        batch = np.zeros((1, 3))
        X.tree_shap_batch(tree, x.reshape(1, 3), batch)
        assert np.allclose(batch[0], phi, atol=1e-12)
        looked_up = np.zeros((1, 3))
        X.add_shap(X.prepared_trees([tree])[0], x.reshape(1, 3), looked_up)
        assert np.allclose(looked_up[0], phi, atol=1e-12)
        assert phi.sum() + X.expected_value(tree) == pytest.approx(tree_predict(tree, x))


def test_exact_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.8, 1), (0.2, 0)], "prob double, Exited int")
    # positives: 0.4, 0.8, 0.8; negatives: 0.1, 0.4, 0.2 -> pairs won 8, tie 1 -> (8 + 0.5) / 9
    assert ML.auc_exact(df) == pytest.approx(8.5 / 9)
    assert ML.auc_exact(df.where("Exited = 1")) is None


def test_metrics_zero_division(spark):
    conf = spark.createDataFrame([(0, 0, 5), (1, 0, 3)], "actual int, predicted int, n long")
    m = ML.metrics_from_confusion(conf).first()
    assert (m["precision"], m["recall"], m["f1_score"], m["accuracy"]) == (0.0, 0.0, 0.0, 0.625)


def test_exact_knn_matches_brute_force(spark):
    from churnlake.operators.knn import exact_knn_with_duplicates
    rng = np.random.default_rng(11)
    pts = rng.normal(size=(300, 4))
    pts[:40] = pts[0]                       # a hot value: 40 equal rows
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, f array<double>")
    got = {r["id"]: r["nb"] for r in exact_knn_with_duplicates(df, 5, seed=3).collect()}
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(pts)):
        found = sorted(np.sqrt(((pts[i] - np.array(v)) ** 2).sum()) for v in got[i])
        assert len(found) == 5
        assert found == pytest.approx(sorted(d[i])[:5], abs=1e-12)


def test_smote_is_a_no_op_when_balanced_or_single_class(spark):
    df, _rows = _points(spark, 40, 40)
    assert smote(df).count() == 0                      # 0.75 x 40 - 40 < 0: nothing to add
    one = df.where("Exited = 1")
    out = smote(one)
    assert out.count() == 0 and "is_synthetic" in out.columns
    assert df.unionByName(out.drop("is_synthetic")).count() == 80


def test_exact_knn_multi_cell_path_matches_brute_force(spark):
    """Force the cell + verification path with a tiny block size."""
    from churnlake.operators.knn import exact_knn
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(400, 3))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, f array<double>")
    got = {r["id"]: [h["dist"] for h in r["knn"]] for r in exact_knn(df, 4, block=64, first_probes=1).collect()}
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(pts)):
        assert got[i] == pytest.approx(sorted(d[i])[:4], abs=1e-12)


@pytest.mark.parametrize("n", [300, 1200])
def test_leaves_of_the_cell_tree_stay_bounded_as_rows_grow(spark, n):
    from churnlake.operators import knn

    rng = np.random.default_rng(n)
    pts = np.concatenate([rng.normal(size=(n // 2, 3)) * 0.01, rng.normal(size=(n // 2, 3)) * 3])  # half of all rows close together
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, f array<double>").repartition(3)
    tree = knn.grow_cells(df, 32, 7)
    leaf = tree.leaf_of(pts)
    assert np.bincount(leaf).max() <= 32 and len(np.unique(leaf)) >= n / 32
    below = {int(c): i for i, own in enumerate(tree.children) for c in own if c >= 0}
    for i, p in enumerate(pts):  # a radius holds for every cell that a point lies in, inner ones too
        cell = int(leaf[i])
        while cell is not None:
            assert np.linalg.norm(p - tree.centres[cell]) <= tree.radii[cell] * (1 + 1e-12)
            cell = below.get(cell)
    if n == 300:
        got = {r["id"]: [h["dist"] for h in r["knn"]] for r in knn.exact_knn(df, 5, block=32).collect()}
        d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        assert len(got) == n
        for i in range(n):
            assert got[i] == pytest.approx(sorted(d[i])[:5], abs=1e-12)


def _customers(n):
    """Rows like the scaled customers: flags, steps, a few continuous features and products and sums of them."""
    rng = np.random.default_rng(n)
    flags = (rng.random((n, 6)) < 0.4) * 2.0
    steps = rng.integers(0, 4, (n, 3)) * 0.8
    free = rng.normal(size=(n, 2))
    return np.concatenate([flags, steps, free, flags[:, :3] * free[:, :1], steps + flags[:, 1:4], flags[:, 3:] * free[:, 1:]], axis=1)


def _reached(spark, pts, block, k=5):
    """(leaves that a row's neighbours may be in, on average; leaves)"""
    from churnlake.operators import knn

    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, f array<double>").repartition(3)
    tree = knn.grow_cells(df, block, 7)
    some = pts[:: len(pts) // 100]
    kth = np.sort(np.sqrt(((some[:, None] - pts[None]) ** 2).sum(-1)), axis=1)[:, k]
    return sum(len(row) for row, _ in tree.reachable(some, kth)) / len(some), len(np.unique(tree.leaf_of(pts)))


def test_leaves_that_a_neighbour_search_reaches_do_not_grow_with_the_rows(spark):
    few, _ = _reached(spark, _customers(2000), 64)
    many, leaves = _reached(spark, _customers(8000), 64)
    assert many <= 1.2 * few and many <= 0.1 * leaves


def test_exact_knn_of_mixed_features_matches_brute_force(spark):
    from churnlake.operators.knn import exact_knn

    pts = np.unique(_customers(600), axis=0)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, f array<double>")
    got = {r["id"]: [h["dist"] for h in r["knn"]] for r in exact_knn(df, 5, block=32).collect()}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert len(got) == len(pts)
    for i in range(len(pts)):
        assert got[i] == pytest.approx(sorted(d[i])[:5], abs=1e-12)


def test_exact_knn_when_the_first_probes_leave_nothing_to_verify(spark):
    """Groups of 8 equal distances far apart: no leaf is left for the second round of most frames."""
    from churnlake.operators.knn import exact_knn

    at = [1000.0 * (i // 8) + i % 8 for i in range(64)]
    df = spark.createDataFrame([(i, [a]) for i, a in enumerate(at)], "id long, f array<double>").repartition(2)
    got = {r["id"]: [h["dist"] for h in r["knn"]] for r in exact_knn(df, 3, block=16).collect()}
    for i, a in enumerate(at):
        assert got[i] == sorted(abs(a - b) for j, b in enumerate(at) if j != i)[:3]


def test_ranking_a_cell_takes_few_of_its_rows(spark):
    """The first cell holds all rows: its sample is that of the smallest hashes, found without ranking every row."""
    from pyspark.sql import functions as F

    from churnlake.operators import knn

    placed = spark.range(40000).select("id", F.array(F.col("id").cast("double")).alias("f"), F.when(F.col("id") < 39000, 0).otherwise(5).cast("long").alias("cell"))
    large = spark.createDataFrame([(0, 4, 39000), (5, 1, 1000)], "cell long, levels int, n long")
    drawn = [(r["cell"], r["h"], r["id"]) for r in knn._drawn(placed, large, 7).collect()]
    every = placed.select("cell", F.xxhash64("id", F.lit(7), "cell").alias("h"), "id").collect()
    few = [r for r in drawn if r[0] == 0]
    assert knn.SAMPLE <= len(few) <= 3 * knn.SAMPLE and len(drawn) - len(few) == 1000
    assert sorted(few)[: knn.SAMPLE] == sorted(tuple(r) for r in every if r["cell"] == 0)[: knn.SAMPLE]


def test_the_tree_is_grown_without_a_shuffle_of_all_rows(spark, monkeypatch):
    """Rows that reach the ranking of a cell, over all scans, do not grow with the rows."""
    from churnlake.operators import knn

    monkeypatch.setattr(knn, "SAMPLE", 64)
    reached, ranked = [], knn._drawn
    monkeypatch.setattr(knn, "_drawn", lambda *a: reached.append(ranked(*a)) or reached[-1])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(_customers(6000))], "id long, f array<double>").repartition(3)
    tree = knn.grow_cells(df, 1000, 7)
    assert tree.is_leaf(np.arange(len(tree.children))).sum() >= 6 and reached[0].count() <= 3 * 64


def test_rows_that_do_not_differ_are_not_cut():
    from churnlake.operators.knn import _cuts

    assert _cuts(np.full((9, 3), 0.1), 4) == [] and _cuts(np.full((9, 2), np.nan), 4) == []
    assert _cuts(np.array([[1.0, 0.0], [1.0, 0.0], [1.0, 2.0]]), 4) == [(1, 1, 0.0)]


def test_decision_tree_takes_the_best_of_all_thresholds(spark):
    """Every split of the depth-8 tree has the largest gain of all thresholds between two values, and every
    leaf is pure, at full depth or has no allowed split with a gain (leaves of 10 rows, splits of 20)."""
    from churnlake.operators.prep import ml_matrix

    train = ml_matrix(stages.features(spark, SF_SMALL), keep=[C.ID])
    prepared = ML.prepare_training(train, False)
    s = C.MODEL_SETTINGS["DecisionTree"]
    model = ML.fit_prepared("DecisionTree", s, prepared)
    rows = ML.with_weights(prepared[2], "balanced").collect()
    x, y, w = np.array([r["features"].toArray() for r in rows]), np.array([r["Exited"] for r in rows]), np.array([r["weight"] for r in rows])
    (tree,) = X.tree_ensemble(model)[0]

    def impurity(at):
        p = (w[at] * y[at]).sum() / w[at].sum()
        return 2 * p * (1 - p)

    def gain(at, left):
        a, b = at[left], at[~left]
        if min(len(a), len(b)) < s["min_leaf"]:
            return -1.0
        total = w[at].sum()
        return impurity(at) - w[a].sum() / total * impurity(a) - w[b].sum() / total * impurity(b)

    def best(at):
        found = 0.0
        for f in range(x.shape[1]):
            for v in np.unique(x[at, f])[:-1]:
                found = max(found, gain(at, x[at, f] <= v))
        return found

    todo, splits = [(0, np.arange(len(x)), 0)], 0
    while todo:
        node, at, depth = todo.pop()
        if tree["left"][node] < 0:
            assert depth == s["max_depth"] or best(at) < 1e-9
            continue
        assert len(at) >= 20
        left = x[at, tree["feature"][node]] <= tree["threshold"][node]
        assert gain(at, left) == pytest.approx(best(at), abs=1e-9)
        splits += 1
        todo += [(tree["left"][node], at[left], depth + 1), (tree["right"][node], at[~left], depth + 1)]
    assert splits >= 3
    prepared[2].unpersist()


def test_leaf_tables_equal_the_recursion_on_grown_trees():
    from churnlake.operators import boosting as B
    from tests.test_boosting import make_block

    block, starts = make_block(500, seed=4)
    x = np.random.default_rng(1).uniform(0, 30, size=(200, 5))
    s = B.Boosting(rounds=3, depth=7, step=0.5, l2=0.0, min_hessian=0.0, min_rows=2)
    for tree in B.boost_block(block, 0, s, starts, 2.0**30, 0.0):
        table = B._table(tree, s, 2.0**30, [np.arange(n - 1) + 0.5 for n in np.diff(starts)])
        want, got = np.zeros((200, 5)), np.zeros((200, 5))
        X.tree_shap_batch(table, x, want)
        X.add_shap(X.prepared_trees([table])[0], x, got)
        assert np.abs(want).max() > 0.01 and np.allclose(got, want, atol=1e-12)
        assert np.allclose(got.sum(axis=1) + X.expected_value(table), X.tree_predict_batch(table, x), atol=1e-12)


def test_explanation_of_deep_trees_is_dealt_to_all_cores(spark):
    """Rows of one small file are explained by several tasks; deep trees with features met twice, as the scalar recursion."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler

    from churnlake.operators import boosting as B

    rng = np.random.default_rng(6)
    names = [f"f{i}" for i in range(11)]
    rows = np.round(rng.normal(size=(1200, 11)), 2)
    frame = spark.createDataFrame([(i, *map(float, r), float(r[:3].sum() + r[3] * r[4] > rng.normal())) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{n} double" for n in names) + ", Exited double").coalesce(1)
    stage = VectorAssembler(inputCols=names, outputCol="features")
    s = B.Boosting(objective="share", rounds=3, depth=None, step=1.0, l2=0.0, min_hessian=0.0, min_rows=2, bootstrap=True, node_columns=3)
    binned = B.bin_rows(frame, F.array(*names), "Exited", [F.lit(1.0)])
    model = PipelineModel(stages=[stage, B.as_model(B.train(binned, [(s, 0)])[0], s, 11)])
    assert max(len(p[0]) for t in model.stages[-1].trees for p in X.leaf_paths(t)) > X.PATTERN_FEATURES
    long = X.tree_shap_frame(model, frame, "id", names)
    assert long.rdd.getNumPartitions() > 1
    assert X.additivity_gap(long, "id").agg(F.max("gap")).first()[0] < 1e-9
    for i in (0, 7, 1199):
        phi = np.zeros(11)
        for t in model.stages[-1].trees:
            tree_shap(t, rows[i], phi, 1 / 3)
        got = {r["feature"]: r["shap_value"] for r in long.where(F.col("id") == i).collect()}
        assert np.allclose([got[n] for n in names], phi, atol=1e-10)


def _deep_trees(rows=2000, features=11):
    from churnlake.operators import boosting as B

    rng = np.random.default_rng(9)
    codes = rng.integers(0, 20, size=(features, rows)).astype("<u2")
    y = (codes[:4].sum(axis=0) + rng.normal(0, 8, rows) > 38).astype(float)
    block = B.Block({"rows": rows, "keys": rng.integers(-2**62, 2**62, rows).tobytes(), "codes": codes.tobytes(), "y": y.tobytes(), "weights": np.ones((rows, 1)).tobytes(), "margins": b""}, 1, 1)
    s = B.Boosting(objective="share", rounds=3, depth=12, step=1.0, l2=0.0, min_hessian=0.0, min_rows=5, bootstrap=True, node_columns=3)
    starts = np.arange(features + 1) * 20
    return [B._table(t, s, 2.0**30, [np.arange(19) + 0.5] * features) for t in B.boost_block(block, 0, s, starts, 2.0**30, 0.0)], codes.astype(float)


@pytest.mark.parametrize("per_pattern, leaf_patterns, held", [(24, 1 << 13, 1 << 18), (1, 1 << 13, 1), (1000, 1 << 13, 1 << 12), (24, 4, 1 << 18)])
def test_pieces_of_trees_equal_the_recursion(monkeypatch, per_pattern, leaf_patterns, held):
    trees, x = _deep_trees()
    assert max(len(p[0]) for t in trees for p in X.leaf_paths(t)) > X.PATTERN_FEATURES
    monkeypatch.setattr(X, "ROWS_PER_PATTERN", per_pattern)
    monkeypatch.setattr(X, "ROWS_PER_PIECE", 0)
    monkeypatch.setattr(X, "LEAF_PATTERNS", leaf_patterns)  # with 4 no tree can be cut, all go the other way
    monkeypatch.setattr(X, "HELD_VALUES", held)
    stump = {"feature": np.array([-1]), "threshold": np.zeros(1), "left": np.array([-1]), "right": np.array([-1]), "cover": np.ones(1), "value": np.array([0.3])}
    want, got = np.zeros((x.shape[1], 11)), np.zeros((11, x.shape[1]))
    for t, w in zip(trees, (0.5, 0.25, 2.0)):
        X.tree_shap_batch(t, x.T, want, w)
    X.add_shap_by_pieces([stump, *trees], x, got, [1.0, 0.5, 0.25, 2.0])
    assert np.abs(want).max() > 0.01 and np.allclose(got.T, want, atol=1e-12)


def test_rows_look_patterns_up_instead_of_going_down_deep_trees(monkeypatch):
    trees, x = _deep_trees()
    x = np.tile(x, (1, 20))
    worked, factor = [], X._factor

    def counted(points, on, z):
        worked.append(on.size)
        return factor(points, on, z)

    monkeypatch.setattr(X, "_factor", counted)
    monkeypatch.setattr(X, "tree_shap_batch", lambda *_: pytest.fail("rows gone down a tree"))
    X.add_shap_by_pieces(trees, x, np.zeros(x.shape), [1.0] * 3)
    assert sum(worked) < sum(len(t["feature"]) for t in trees) * x.shape[1] / 4


def test_explanation_keeps_repeated_and_missing_keys(spark):
    """Rows are told apart by their block, not by their key."""
    frame = spark.createDataFrame([(i // 2 if i % 7 else None, float(i % 13), float(i % 5), float((i % 13) > 6)) for i in range(1300)], "id long, a double, b double, Exited double")
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler

    from churnlake.operators import boosting as B

    s = B.Boosting(rounds=2, depth=3, step=0.5)
    model = PipelineModel(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), B.as_model(B.train(B.bin_rows(frame, F.array("a", "b"), "Exited", [F.lit(1.0)]), [(s, 0)])[0], s, 2)])
    long = X.tree_shap_frame(model, frame, "id", ["a", "b"])
    got = sorted((r["id"] is None, r["id"] or 0, r["feature"], r["feature_value"]) for r in long.collect())
    assert got == sorted((r["id"] is None, r["id"] or 0, c, r[c]) for r in frame.collect() for c in "ab")
    assert X.tree_shap_frame(model, frame.limit(0), "id", ["a", "b"]).count() == 0
