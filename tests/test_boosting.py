"""Boosting on shared histograms: trees against a plain grower, joint folds, both ways of training, the saved stage."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.functions import sums
from churnlake.operators import boosting as B
from churnlake.operators import ml as ML
from churnlake.operators.prep import ml_matrix
from churnlake.plans import stages
from tests.conftest import SF_SMALL
from tests.shap_reference import tree_predict

LEVEL = B.Boosting(rounds=4, depth=4, step=0.3, l2=1.0, min_hessian=1.0)
LEAF = B.Boosting(rounds=4, depth=6, step=0.3, leaves=7, l2=0.0, min_hessian=1e-3, min_rows=5)


def make_block(n=400, d=5, seed=0, weights=1):
    rng = np.random.default_rng(seed)
    codes = np.stack([rng.integers(0, size, n) for size in (2, 9, 30, 30, 4)[:d]]).astype("<u2")
    y = (rng.random(n) < 1 / (1 + np.exp(-(codes[2] / 10.0 - 1.5 + (codes[1] > 4) * codes[3] / 12.0 - 1.0)))).astype(float)
    block = B.Block({"rows": n, "keys": rng.integers(-2**62, 2**62, n).tobytes(), "codes": codes.tobytes(), "y": y.tobytes(), "weights": np.ones((n, weights)).tobytes(), "margins": b""}, weights, 1)
    return block, np.append(0, np.cumsum([2, 9, 30, 30, 4][:d]))


def plain_tree(codes, g, h, live, sizes, s, columns):
    """Best-first growth with loops: {path: (feature, cut)}, {path: rows of a leaf}."""
    def best(rows):
        G, H, found = g[rows].sum(), h[rows].sum(), None
        for f in columns:
            for cut in range(sizes[f] - 1):
                left = codes[f, rows] <= cut
                a, b = rows[left], rows[~left]
                if min(len(a), len(b)) < s.min_rows or not len(a) or not len(b) or min(h[a].sum(), h[b].sum()) < s.min_hessian:
                    continue
                gain = g[a].sum() ** 2 / (h[a].sum() + s.l2) + g[b].sum() ** 2 / (h[b].sum() + s.l2) - G * G / (H + s.l2)
                if gain > B.MIN_GAIN and (found is None or gain > found[0]):
                    found = gain, f, cut, a, b
        return found

    leaves, splits = {"": np.flatnonzero(live)}, {}
    open_ = {"": best(leaves[""])}
    while s.leaves is None or len(leaves) < s.leaves:
        ready = [(-v[0], p) for p, v in open_.items() if v is not None and len(p) < s.depth]
        if not ready:
            break
        path = min(ready)[1]
        _, f, cut, a, b = open_.pop(path)
        del leaves[path]
        splits[path] = (f, cut)
        for end, rows in (("0", a), ("1", b)):
            leaves[path + end] = rows
            open_[path + end] = best(rows)
    return splits, leaves


@pytest.mark.parametrize("s", [LEVEL, LEAF, B.Boosting(rounds=3, depth=3, step=0.5, rows=0.7, columns=0.6), B.Boosting(rounds=2, depth=12, leaves=5, l2=0.5, min_rows=3), B.Boosting(rounds=2, depth=0)])
def test_trees_equal_a_plain_grower(s):
    block, starts = make_block()
    unit, margin = 2.0**30, np.zeros(len(block.y))
    for number, tree in enumerate(B.boost_block(block, 0, s, starts, unit, 0.0)):
        g, h = (v / unit for v in B.gradients(margin, block.y, block.weights[0], unit))
        splits, leaves = plain_tree(block.codes, g, h, B.drawn_rows(block.keys, s, number) > 0, np.diff(starts), s, B.drawn_columns(len(starts) - 1, s, number))
        assert {p: (f, c) for p, f, c, left in zip(tree.path, tree.feature, tree.cut, tree.left) if left >= 0} == splits
        values = {p: v for p, v, left in zip(tree.path, B.leaf_values(tree, s, unit), tree.left) if left < 0}
        assert set(values) == set(leaves)
        for path, rows in leaves.items():
            assert values[path] == pytest.approx(-s.step * g[rows].sum() / (h[rows].sum() + s.l2), rel=1e-12)
        margin += B.leaf_values(tree, s, unit)[B.walk(tree.arrays(), block.codes)]
    assert number == s.rounds - 1


def test_leaf_wise_growth_differs_from_level_wise():
    block, starts = make_block(seed=3)
    by_leaf = next(B.boost_block(block, 0, LEAF, starts, 2.0**30, 0.0))
    level = next(B.boost_block(block, 0, B.Boosting(rounds=1, depth=3, step=0.3, l2=0.0, min_hessian=1e-3, min_rows=5), starts, 2.0**30, 0.0))
    assert sum(x < 0 for x in by_leaf.left) == 7 and max(map(len, by_leaf.path)) > 3
    assert set(level.path) != set(by_leaf.path) and max(map(len, level.path)) == 3


def test_one_label_or_no_row_gives_constant_trees():
    block, starts = make_block(40)
    block.y = np.ones(40)
    tree = next(B.boost_block(block, 0, LEAF, starts, 2.0**30, 0.0))
    assert len(tree.feature) >= 1 and all(math.isfinite(v) for v in B.leaf_values(tree, LEAF, 2.0**30))
    block.weights = np.zeros_like(block.weights)
    tree = next(B.boost_block(block, 0, LEVEL, starts, 2.0**30, 0.0))
    assert tree.feature == [-1] and B.leaf_values(tree, LEVEL, 2.0**30).tolist() == [0.0]


@pytest.fixture(scope="module")
def binned(spark):
    mat = ML.assembler().transform(ML.folds(ml_matrix(stages.features(spark, SF_SMALL), keep=[C.ID]), 3))
    weights = [F.when(F.col("fold") != i, F.lit(1.0 + i)).otherwise(F.lit(0.0)) for i in range(3)]
    return B.bin_rows(mat, vector_to_array("raw_features"), C.TARGET, weights)


def same_trees(a, b):
    assert len(a) == len(b)
    for s, t in zip(a, b):
        assert s["base"] == t["base"]
        for k in ("feature", "threshold", "left", "right", "cover", "value"):
            assert np.array_equal(s[k], t[k]), k


def test_joint_folds_equal_separate_ones(binned):
    models = [(LEVEL, 0), (LEVEL, 1), (LEVEL, 2), (LEAF, 1)]
    joint = B.train(binned, models, from_average=True)
    for m, trees in zip(models, joint):
        same_trees(trees, B.train(binned, [m], from_average=True)[0])
    assert not np.array_equal(joint[0][0]["value"], joint[1][0]["value"])


@pytest.mark.parametrize("fan", [32, 2])
def test_spark_jobs_give_the_trees_of_one_block(spark, binned, monkeypatch, fan):
    models = [(B.Boosting(rounds=3, depth=3, step=0.3, rows=0.8, columns=0.8), 0), (B.Boosting(rounds=2, depth=6, leaves=6, l2=0.0, min_hessian=1e-3, min_rows=5), 1),
              (B.Boosting(objective="share", rounds=5, depth=None, step=1.0, l2=0.0, min_hessian=0.0, min_rows=4, bootstrap=True, node_columns=4), 2)]
    monkeypatch.setattr(B, "GROUP", 2)
    want = B.train(binned, models)
    monkeypatch.setattr(B, "BLOCK_ROWS", 20)
    monkeypatch.setattr(B, "BLOCKS_PER_PART", 2)
    mat = ML.assembler().transform(ML.folds(ml_matrix(stages.features(spark, SF_SMALL), keep=[C.ID]), 3))
    small = B.bin_rows(mat, vector_to_array("raw_features"), C.TARGET, [F.when(F.col("fold") != i, F.lit(1.0 + i)).otherwise(F.lit(0.0)) for i in range(3)])
    assert small.blocks.count() > 4
    small.units = binned.units
    monkeypatch.setattr(B, "LOCAL_CELLS", 0)
    monkeypatch.setattr(B, "CUT_ROUNDS", 2)
    monkeypatch.setattr(B, "JOB_BYTES", 24 * int(small.starts[-1]) * 5)  # several jobs a pass
    monkeypatch.setattr(B, "KEPT_BYTES", 24 * int(small.starts[-1]) * 3)  # some parents are not kept
    monkeypatch.setattr(sums, "FAN", fan)
    for a, b in zip(want, B.train(small, models)):
        same_trees(a, b)


def test_bins_hold_nulls_and_nothing(spark):
    frame = spark.createDataFrame([([1.0, None], 1.0), ([float("nan"), 2.0], 0.0), ([3.0, 2.0], None)], "x array<double>, y double").na.fill(0.0, ["y"])
    b = B.bin_rows(frame, "x", "y", [F.lit(1.0)])
    assert [t.tolist() for t in b.thresholds] == [[0.5, 2.0], [1.0]] and b.rows == 3
    assert len(B.train(b, [(LEVEL, 0)])[0]) == LEVEL.rounds
    assert B.train(B.bin_rows(frame.limit(0), "x", "y", [F.lit(1.0)]), [(LEVEL, 0)]) == [[]]


def test_stage_scores_prefixes_and_saves(spark, tmp_path):
    mat = ML.assembler().transform(ml_matrix(stages.features(spark, SF_SMALL), keep=[C.ID]))
    s = {"rounds": 6, "max_depth": 3, "step": 0.2}
    long, short = (ML.tree_models(mat, [("GBT_Balanced", {**s, "rounds": r}, F.lit(1.0))], vector_to_array("raw_features"), "raw_features")[0] for r in (6, 4))
    same_trees([{"base": 0, **t} for t in long.prefix(4).trees], [{"base": 0, **t} for t in short.trees])
    model = PipelineModel(stages=[long])
    rows = model.transform(mat).select(vector_to_array("raw_features").alias("x"), vector_to_array("rawPrediction")[1].alias("m"), vector_to_array("probability")[1].alias("p")).collect()
    for r in rows[:40]:
        margin = long.getOrDefault("base") + sum(tree_predict(t, np.array(r["x"])) for t in long.trees)
        assert r["m"] == pytest.approx(margin, abs=1e-12) and r["p"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-12)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    back = again.transform(mat).select(vector_to_array("rawPrediction")[1].alias("m")).collect()
    assert [r["m"] for r in back] == [r["m"] for r in rows]
    assert again.stages[0].uid == long.uid and abs(sum(again.stages[0].featureImportances) - 1) < 1e-12


def test_cross_validation_of_all_models_equals_one_by_one(spark):
    mat = ml_matrix(stages.features(spark, SF_SMALL), keep=[C.ID])
    names = ["LogisticRegression", "GBT_LevelWise", "GBT_Balanced"]
    settings = {**C.MODEL_SETTINGS_LIGHT, "GBT_LevelWise": {"rounds": 5, "max_depth": 3, "step": 0.1, "subsample": 0.8, "colsample": 0.8}, "GBT_Balanced": {"rounds": 5, "max_depth": 3, "step": 0.1}}
    joint = ML.cross_validate_all(names, settings, mat, 3)
    assert list(joint) == names
    for name in names:
        alone = ML.cross_validate(name, settings[name], mat, 3)
        assert {k: v for k, v in alone.items()} == pytest.approx(joint[name], abs=1e-9)


def test_forest_trees_are_shares_of_drawn_rows():
    block, starts = make_block(300, seed=8)
    s = B.Boosting(objective="share", rounds=6, depth=12, step=1.0, l2=0.0, min_hessian=0.0, min_rows=5, bootstrap=True, node_columns=2)
    unit = 2.0**30
    every = list(B.boost_block(block, 0, s, starts, unit, 0.0))
    assert [t.path for t in B.boost_block(block, 0, s, starts, unit, 0.0, range(3, 5))] == [t.path for t in every[3:5]]
    assert len({tuple(t.path) for t in every}) > 1
    counts = B.drawn_rows(np.random.default_rng(0).integers(0, 2**62, 200_000).astype(np.uint64), s, 1)
    assert counts.mean() == pytest.approx(1, abs=0.01) and counts.var() == pytest.approx(1, abs=0.02)
    for number, tree in enumerate(every):
        times, leaf, values = B.drawn_rows(block.keys, s, number), B.walk(tree.arrays(), block.codes), B.leaf_values(tree, s, unit)
        for node in np.unique(leaf[times > 0]):
            own = (leaf == node) & (times > 0)
            assert own.sum() >= s.min_rows
            assert values[node] == pytest.approx((times[own] * block.y[own]).sum() / times[own].sum(), rel=1e-9)


def test_search_shares_folds_and_prefixes(spark):
    train = ml_matrix(stages.features(spark, SF_SMALL), keep=[C.ID])
    base = {"rounds": 4, "max_depth": 3, "step": 0.1, "subsample": 0.8, "colsample": 0.8}
    best, auc, tried = ML.random_search("GBT_LevelWise", base, {"rounds": [2, 4], "max_depth": [2, 3]}, train, n_iter=4, k=2)
    assert len(tried) == 4 and auc == max(a for _, a in tried)
    alone = ML.random_search("GBT_LevelWise", base, {"rounds": [2], "max_depth": [3]}, train, n_iter=1, k=2)[2]
    assert dict((tuple(sorted(p.items())), a) for p, a in tried)[("max_depth", 3), ("rounds", 2)] == pytest.approx(alone[0][1], abs=1e-12)


def test_search_of_a_forest_scores_prefixes(spark):
    train = ml_matrix(stages.features(spark, SF_SMALL), keep=[C.ID])
    base = {"n_trees": 5, "max_depth": 4, "min_leaf": 5}
    tried = ML.random_search("RandomForest", base, {"n_trees": [2, 5], "max_depth": [4, None]}, train, n_iter=4, k=2)[2]
    alone = ML.random_search("RandomForest", base, {"n_trees": [2], "max_depth": [None]}, train, n_iter=1, k=2)[2]
    assert [a for p, a in tried if p == {"n_trees": 2, "max_depth": None}] == pytest.approx([alone[0][1]], abs=1e-12)


def test_driver_gets_a_line_per_node(spark, monkeypatch):
    """However many bins a feature has and partitions there are: no histogram reaches the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    frame = spark.range(3000).select(F.array(*[F.rand(i) for i in range(4)]).alias("x"), (F.rand(9) < 0.4).cast("double").alias("y"))
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    monkeypatch.setattr(B, "BLOCKS_PER_PART", 2)
    binned = B.bin_rows(frame, "x", "y", [F.lit(1.0)], 1000)
    monkeypatch.setattr(B, "LOCAL_CELLS", 0)
    got = []
    collect, to_arrow = DataFrame.collect, DataFrame.toArrow

    def collected(self):
        rows = collect(self)
        got.append(sum(len(v) for r in rows for v in r if isinstance(v, bytes | bytearray)))
        return rows

    def as_arrow(self):
        table = to_arrow(self)
        got.append(table.nbytes)
        return table

    monkeypatch.setattr(DataFrame, "collect", collected)
    monkeypatch.setattr(DataFrame, "toArrow", as_arrow)
    forest = B.Boosting(objective="share", rounds=2, depth=3, step=1.0, l2=0.0, min_hessian=0.0, bootstrap=True, node_columns=2)
    trees = B.train(binned, [(forest, 0), (B.Boosting(rounds=1, depth=3, step=0.3), 0)])
    assert all(len(t["feature"]) > 3 for m in trees for t in m)
    assert 0 < max(got) < 24 * int(binned.starts[-1]) / 8


def test_forest_sums_only_the_columns_drawn_at_a_node(monkeypatch):
    block, starts = make_block(300, seed=8)
    s = B.Boosting(objective="share", rounds=2, depth=None, step=1.0, l2=0.0, min_hessian=0.0, min_rows=5, bootstrap=True, node_columns=2)
    monkeypatch.setattr(B, "histograms", lambda *_: pytest.fail("whole histograms"))
    trees = list(B.boost_block(block, 0, s, starts, 2.0**30, 0.0))
    for number, tree in enumerate(trees):
        for path, f, left in zip(tree.path, tree.feature, tree.left):
            drawn = np.random.default_rng([s.seed, number, int("1" + path, 2)]).permutation(5)[:2]
            assert left < 0 or f in drawn


def test_splits_of_many_nodes_equal_those_of_one():
    block, starts = make_block(600, seed=5)
    rng = np.random.default_rng(2)
    g, h, slot = np.rint(rng.normal(size=600) * 1e6), np.rint(rng.random(600) * 1e6), rng.integers(-1, 7, 600)
    for s in (B.Boosting(min_rows=3, seed=1), B.Boosting(min_rows=3, columns=0.6, min_hessian=2.0, seed=1)):
        columns = B.columns_of(s, starts, 4, [""] * 7)
        places = B.Places(starts, B.drawn_columns(5, s, 4))
        got = B.best_splits(*B.sparse_sums(block.codes, starts, slot, 7, g, h, columns), 7, s, starts, 1e5)
        for hist, (total, split) in zip(B.histograms(block.codes, starts, slot, 7, g, h), got):
            assert total.tolist() == hist[: starts[1]].sum(axis=0).tolist()
            want = B.best_split(hist, total, s, places, 1e5)
            assert (want is None) == (split is None) and (want is None or (want[:2] == split[:2] and want[2].tolist() == split[2].tolist()))


def test_joint_codes_give_the_histograms_of_each_feature(monkeypatch):
    block, starts = make_block(900, seed=11)
    rng = np.random.default_rng(4)
    g, h, rows = np.rint(rng.normal(size=900) * 1e6), np.rint(rng.random(900) * 1e6), np.sort(rng.permutation(900)[:500])
    slot = np.full(900, -1)
    slot[rows] = 0
    monkeypatch.setattr(B, "SUM_ROWS", 64)
    want = B.histograms(block.codes, starts, slot, 1, g, h)[0]
    for cells in (1, 40, 300, 1 << 20):
        joint = B.Joint(block.codes, starts, cells)
        assert sorted(f for m in joint.members for f in m) == [0, 1, 2, 3, 4]
        assert joint.sums(rows, g, h, set(range(5))).tolist() == want.tolist()
    assert len(joint.members) == 1 and joint.sums(rows, g, h, {1})[2:11].tolist() == want[2:11].tolist()


def test_boosters_read_only_rows_of_the_nodes_they_gather(monkeypatch):
    """Rows are kept by node: no pass walks all rows from the root, and of two children only the smaller one's rows are summed."""
    block, starts = make_block(3000, seed=12)
    monkeypatch.setattr(B, "walk", lambda *_: pytest.fail("all rows walked from the root"))
    read, sums = [], B.Joint.sums

    def counted(self, rows, *rest):
        read.append(len(rows))
        return sums(self, rows, *rest)

    monkeypatch.setattr(B.Joint, "sums", counted)
    s = B.Boosting(rounds=1, depth=3, step=0.3)
    tree = next(B.boost_block(block, 0, s, starts, 2.0**30, 0.0))
    assert max(map(len, tree.path)) == 3 and sum(read) <= 3000 + 2 * 1500


def test_rows_of_local_training_do_not_pass_the_driver(binned, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    got, collect = [], DataFrame.collect

    def collected(self):
        rows = collect(self)
        got.append(sum(len(v) for r in rows for v in r if isinstance(v, bytes | bytearray)))
        return rows

    monkeypatch.setattr(DataFrame, "collect", collected)
    monkeypatch.setattr(B, "_train_spark", lambda *_: pytest.fail("jobs per pass"))
    forest = B.Boosting(objective="share", rounds=20, depth=3, step=1.0, l2=0.0, min_hessian=0.0, bootstrap=True, node_columns=2)
    trees = B.train(binned, [(LEVEL, 0), (forest, 1), (LEAF, 2)], from_average=True)
    assert [len(t) for t in trees] == [LEVEL.rounds, 20, LEAF.rounds] and sum(got) == 0


def test_units_of_boosters_come_first_and_forests_are_cut_to_the_tasks():
    forest = B.Boosting(objective="share", rounds=300)
    units = B._units([(forest, 0), (LEVEL, 0), (forest, 1)], 20)
    assert units[0] == (1, 0, 4) and len(units) == 21 and units[1] == (0, 0, 30) and units[-1] == (2, 270, 300)


def test_a_weight_column_without_rows_gives_constant_trees(spark):
    frame = spark.range(60).select(F.array(F.col("id").cast("double"), F.rand(3)).alias("x"), (F.col("id") % 3 == 0).cast("double").alias("y"))
    none, some = B.train(B.bin_rows(frame, "x", "y", [F.lit(0.0), F.lit(1.0)]), [(LEVEL, 0), (LEVEL, 1)])
    assert len(none) == len(some) == LEVEL.rounds and all(t["feature"].tolist() == [-1] for t in none) and any(len(t["feature"]) > 1 for t in some)


def test_tree_models_of_a_run_are_trained_together(spark, monkeypatch):
    """One binned table for all but the single tree, so boosters run beside the forest and not after it."""
    train, calls = B.train, []

    def counted(binned, models, *rest):
        calls.append(len(models))
        return train(binned, models, *rest)

    monkeypatch.setattr(B, "train", counted)
    res = ML.train_all(stages.features(spark, SF_SMALL), settings={**C.MODEL_SETTINGS_LIGHT, "RandomForest": {"n_trees": 3, "max_depth": 4, "min_leaf": 5}})
    assert sorted(calls) == [1, 3] and list(res.models) == list(res.metrics) == ML.MODEL_NAMES
    res.matrix.unpersist()


def test_forest_rows_leave_the_walk_at_leaves(monkeypatch):
    """A pass of a deep tree reads the rows of its open nodes only."""
    block, starts = make_block(3000, seed=21)
    monkeypatch.setattr(B, "walk", lambda *_: pytest.fail("all rows walked"))
    s = B.Boosting(objective="share", rounds=1, depth=None, step=1.0, l2=0.0, min_hessian=0.0, min_rows=5, bootstrap=True, node_columns=2)
    read, sums = [], B.sparse_sums

    def counted(codes, starts, slot, *rest):
        read.append(len(slot))
        return sums(codes, starts, slot, *rest)

    monkeypatch.setattr(B, "sparse_sums", counted)
    tree = next(B.boost_block(block, 0, s, starts, 2.0**30, 0.0))
    assert len(read) > 6 and read == sorted(read, reverse=True) and read[-1] < read[0] / 10
    assert sum(t[2] for t, left in zip(tree.totals, tree.left) if left < 0) == read[0]
