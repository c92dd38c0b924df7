"""Churn classifiers: split, scaling, SMOTE, five models, metrics, CV, search.

Split and folds come from a 52-bit hash of (id, seed): the split takes, per
class, exactly round(20% x class size) rows with the smallest hashes (the cut
is an exact distributed order statistic, so no per-class global sort and no
class-sized window partition); folds cut each class at exact ranks of that hash.
Logistic regression is Spark ML's; tree, forest and the two boosters are
``operators/boosting``. Every model is a ``PipelineModel`` (assembler -> scaler ->
classifier), so it scores raw feature rows, saves and loads with Spark ML
persistence.

Cross-validation and search prepare each fold once for all models and points. All
folds of all tree models are trained together on one binned table (a weight column
per fold), and models that differ only in rounds or trees are prefixes of one fit.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.functions.parallel import parallel_map
from churnlake.functions.stats import exact_order_stats, exact_ranks
from churnlake.operators import boosting as B
from churnlake.operators.prep import ml_matrix
from churnlake.operators.smote import smote

LABEL = C.TARGET
MODEL_NAMES = ["LogisticRegression", "DecisionTree", "RandomForest", "GBT_LevelWise", "GBT_Balanced"]


# --------------------------------------------------------------------------- split
def hash52(id_col: str = C.ID, seed: int = C.SEED) -> Column:
    """First 13 hex digits of md5(id || seed) as a long (same value in DuckDB)."""
    hexs = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 13)
    return F.conv(hexs, 16, 10).cast("long")


def test_quota(n: int, fraction: float = C.TEST_FRACTION) -> int:
    return int(math.floor(fraction * n + 0.5))


def stratified_split(df: DataFrame, fraction: float = C.TEST_FRACTION, seed: int = C.SEED) -> DataFrame:
    """Adds ``is_test``: per class the round(fraction * n_class) rows with the smallest hash."""
    x = df.withColumn("__h", hash52(seed=seed))
    counts = {r[LABEL]: r["n"] for r in x.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
    ranks = {(c,): test_quota(n, fraction) - 1 for c, n in counts.items()}
    thr = exact_order_stats(x, "__h", ranks, by=[LABEL])
    j = x.join(F.broadcast(thr), LABEL, "left")
    return j.withColumn("is_test", F.coalesce(F.col("__h").cast("double") <= F.col("value"), F.lit(False))) \
        .drop("value", "__h")


def folds(df: DataFrame, k: int = C.CV_FOLDS, seed: int = C.SEED) -> DataFrame:
    """Stratified folds: each class is cut at exact ranks of a seeded hash, so every fold has
    its share of every class (to within one row)."""
    x = df.withColumn("__h", hash52(seed=seed))
    counts = {r[LABEL]: r["n"] for r in x.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
    edges = exact_ranks(x, "__h", {c: [-(-i * n // k) for i in range(1, k)] for c, n in counts.items()}, LABEL)
    fold = F.lit(None).cast("int")
    for c, values in edges.items():
        passed = sum(((F.col("__h").cast("double") >= F.lit(v)).cast("int") for v in values if v is not None), F.lit(0))
        fold = F.when(F.col(LABEL).eqNullSafe(F.lit(c)), passed).otherwise(fold)
    return x.withColumn("fold", fold).drop("__h")


def class_weights(df: DataFrame) -> DataFrame:
    """``class_weight='balanced'``: n / (2 * n_class)."""
    g = df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("customers"))
    total = g.agg(F.sum("customers").alias("__n"))
    return g.crossJoin(F.broadcast(total)).select(
        LABEL, "customers", F.round(F.col("__n") / (F.lit(2.0) * F.col("customers")), 6).alias("weight"))


def with_weights(df: DataFrame, scheme: str, pos_weight: float = C.GBT_POS_WEIGHT) -> DataFrame:
    """``weight`` column: balanced (n / (2 n_class), from a 2-row aggregate), positive-class boost, or 1."""
    if scheme == "balanced":
        g = df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("__c"))
        total = g.agg(F.sum("__c").alias("__n"))
        ws = g.crossJoin(F.broadcast(total)).select(LABEL, (F.col("__n") / (F.lit(2.0) * F.col("__c"))).alias("weight"))
        return df.join(F.broadcast(ws), LABEL)
    if scheme == "pos":
        return df.withColumn("weight", F.when(F.col(LABEL) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))
    return df.withColumn("weight", F.lit(1.0))


# --------------------------------------------------------------------------- models
TREE_MODELS = ("DecisionTree", "RandomForest", "GBT_LevelWise", "GBT_Balanced")


def tree_settings(name: str, s: dict, seed: int = C.SEED) -> B.Boosting:
    """Tree: all rows and features, exact thresholds. Forest: rows drawn with replacement per tree, the square root
    of the features per node. Level-wise: rows and columns drawn per tree, regularised. Balanced: leaf-wise, all
    rows and columns. A node of fewer than 2 * min_leaf rows cannot be split (20 rows for leaves of 10)."""
    if name == "DecisionTree":
        return B.Boosting(objective="share", rounds=1, depth=s["max_depth"], min_rows=s["min_leaf"], step=1.0, l2=0.0, min_hessian=0.0, seed=seed)
    if name == "RandomForest":
        return B.Boosting(objective="share", rounds=s["n_trees"], depth=s["max_depth"], min_rows=s["min_leaf"], step=1.0, l2=0.0, min_hessian=0.0,
                          bootstrap=True, node_columns=int(math.sqrt(len(C.ML_FEATURES))), seed=seed)
    if name == "GBT_LevelWise":
        return B.Boosting(rounds=s["rounds"], depth=s["max_depth"], step=s["step"], rows=s.get("subsample", 1.0),
                          columns=s.get("colsample", 1.0), l2=1.0, min_hessian=1.0, seed=seed)
    return B.Boosting(rounds=s["rounds"], depth=s["max_depth"], step=s["step"], leaves=s.get("leaves", C.GBT_LEAVES),
                      l2=0.0, min_hessian=1e-3, min_rows=s.get("min_rows", C.GBT_MIN_ROWS), seed=seed)


def weight_scheme(name: str) -> str:
    return "pos" if name == "GBT_LevelWise" else "balanced"


def tree_models(frame: DataFrame, models: list[tuple[str, dict, Column]], features: Column, features_col: str = "features",
                seed: int = C.SEED) -> list[B.TreesModel]:
    """Fits tree models (name, settings, weight column) together: all on one binned table of ``frame``, but
    single trees on one of finer bins."""
    out: dict[int, B.TreesModel] = {}
    for fine in (True, False):
        some = [(i, n, s, w) for i, (n, s, w) in enumerate(models) if (n == "DecisionTree") == fine]
        if not some:
            continue
        weights = {str(w): w for *_, w in some}
        column = {k: j for j, k in enumerate(weights)}
        binned = B.bin_rows(frame, features, LABEL, list(weights.values()), C.TREE_MAX_BINS if fine else B.MAX_BINS)
        chosen = [(tree_settings(n, s, seed), column[str(w)]) for _, n, s, w in some]
        for (i, *_), (s, _), trees in zip(some, chosen, B.train(binned, chosen)):
            out[i] = B.as_model(trees, s, len(binned.thresholds), features_col)
    return [out[i] for i in range(len(models))]


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(C.ML_FEATURES), outputCol="raw_features", handleInvalid="keep")


@dataclass
class TrainResult:
    models: dict = field(default_factory=dict)          # name -> PipelineModel
    metrics: dict = field(default_factory=dict)         # name -> dict
    test: DataFrame | None = None                       # matrix rows of the test split
    train: DataFrame | None = None
    matrix: DataFrame | None = None                     # the kept frame that test and train read
    smote_rows: int = 0


def prepare_training(train_m: DataFrame, use_smote: bool = True, seed: int = C.SEED):
    """Assembler + scaler fitted on the training rows; scaled rows (+ SMOTE rows), persisted.
    The resampled set depends only on the data and the seed, so all models share it."""
    asm = assembler()
    scaler_model = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True) \
        .fit(asm.transform(train_m))
    scaled = scaler_model.transform(asm.transform(train_m)).select(C.ID, LABEL, "features")
    fit_df = scaled
    if use_smote:
        fit_df = scaled.unionByName(smote(scaled, seed=seed).drop("is_synthetic"))
    # iterative fitters run one job per iteration over this frame: size its partitions
    # to the data (ML_ROWS_PER_PARTITION rows each) and keep it cached
    n = fit_df.count()
    parts = max(1, -(-n // C.ML_ROWS_PER_PARTITION))
    return asm, scaler_model, fit_df.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)


def fit_trees(names: list[str], settings: dict, prepared, seed: int = C.SEED) -> list[PipelineModel]:
    """``fit_prepared`` of several tree models, trained together."""
    asm, scaler_model, fit_df = prepared
    counts = {r[LABEL]: r["n"] for r in fit_df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
    balanced = F.lit(0.0)
    for c in sorted(c for c in counts if c is not None):
        balanced = F.when(F.col(LABEL) == c, F.lit(sum(counts.values()) / (2.0 * counts[c]))).otherwise(balanced)
    weight = {"balanced": balanced, "pos": F.col("weight")}
    todo = [(n, settings[n], weight[weight_scheme(n)]) for n in names]
    found = tree_models(with_weights(fit_df, "pos"), todo, vector_to_array("features"), seed=seed)
    return [PipelineModel(stages=[asm, scaler_model, clf]) for clf in found]


def fit_prepared(name: str, settings: dict, prepared, seed: int = C.SEED) -> PipelineModel:
    asm, scaler_model, fit_df = prepared
    if name in TREE_MODELS:
        return fit_trees([name], {name: settings}, prepared, seed)[0]
    w = with_weights(fit_df, weight_scheme(name))
    total_w = w.agg(F.sum("weight")).first()[0] or 1.0
    clf = LogisticRegression(maxIter=settings["max_iter"], regParam=1.0 / (settings["C"] * max(total_w, 1.0)), elasticNetParam=0.0,
                             standardization=False, featuresCol="features", labelCol=LABEL, weightCol="weight").fit(w)
    return PipelineModel(stages=[asm, scaler_model, clf])


def fit_one(name: str, settings: dict, train_m: DataFrame, use_smote: bool = True, seed: int = C.SEED) -> PipelineModel:
    """Scaler fitted on the training rows, SMOTE on the scaled rows, then the classifier."""
    prepared = prepare_training(train_m, use_smote, seed)
    try:
        return fit_prepared(name, settings, prepared, seed)
    finally:
        prepared[2].unpersist()


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """P(churn) and the 0.5-threshold prediction for every row."""
    out = model.transform(df)
    return out.withColumn("prob", vector_to_array(F.col("probability"))[1]) \
        .withColumn("pred", (F.col("prob") >= 0.5).cast("int")) \
        .drop("raw_features", "__raw", "features", "rawPrediction", "probability", "prediction")


# --------------------------------------------------------------------------- metrics
def confusion(scored: DataFrame, score_col: str = "prob", threshold: float = 0.5) -> DataFrame:
    pred = (F.col(score_col) >= threshold).cast("int")
    return scored.groupBy(F.col(LABEL).alias("actual"), pred.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def metrics_from_confusion(conf: DataFrame) -> DataFrame:
    """accuracy, precision, recall, F1 (zero division -> 0), 4 digits."""
    def cnt(a, p):
        return F.coalesce(F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n"))), F.lit(0))
    tp, fp, fn, tn = cnt(1, 1), cnt(0, 1), cnt(1, 0), cnt(0, 0)
    s = conf.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("tp") * 2 + F.col("fp") + F.col("fn")), F.lit(0.0))
    acc = F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return s.select("tp", "fp", "fn", "tn", F.round(acc, 4).alias("accuracy"), F.round(prec, 4).alias("precision"),
                    F.round(rec, 4).alias("recall"), F.round(f1, 4).alias("f1_score"))


def auc_exact(scored: DataFrame, score_col: str = "prob") -> float | None:
    """ROC AUC with ties averaged: Spark's evaluator without binning (distributed sort by score)."""
    classes = scored.agg(F.countDistinct(LABEL)).first()[0]
    if classes < 2:
        return None
    ev = BinaryClassificationEvaluator(rawPredictionCol=score_col, labelCol=LABEL, metricName="areaUnderROC", numBins=0)
    return float(ev.evaluate(scored.select(F.col(score_col).cast("double").alias(score_col), F.col(LABEL).cast("double").alias(LABEL))))


def evaluate(model: PipelineModel, test_m: DataFrame, name: str) -> dict:
    s = score(model, test_m).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        m = metrics_from_confusion(confusion(s)).first().asDict()
        auc = auc_exact(s)
        m["roc_auc"] = round(auc, 4) if auc is not None else None
        m["model_name"] = name
        return m
    finally:
        s.unpersist()


def train_all(feat: DataFrame, settings: dict | None = None, names=MODEL_NAMES, seed: int = C.SEED,
              cv_folds: int = 0) -> TrainResult:
    """Split, fit every model with SMOTE, evaluate on the holdout, optionally cross-validate."""
    settings = settings or C.MODEL_SETTINGS
    mat = ml_matrix(stratified_split(feat, seed=seed), keep=[C.ID, "is_test"]).persist(StorageLevel.MEMORY_AND_DISK)
    train_m = mat.where(~F.col("is_test")).drop("is_test")
    test_m = mat.where(F.col("is_test")).drop("is_test")
    res = TrainResult(test=test_m, train=train_m, matrix=mat)
    prepared = prepare_training(train_m, True, seed)
    res.smote_rows = prepared[2].count() - train_m.count()

    # models share one cached training frame and the tree models one job; other fits run beside it (Spark schedules
    # jobs from several driver threads), as the original fits with all cores
    trees = [n for n in names if n in TREE_MODELS]
    fits = _parallel(lambda some: fit_trees(some, settings, prepared, seed) if some is trees else [fit_prepared(some, settings[some], prepared, seed)],
                     [*([trees] if trees else []), *[n for n in names if n not in TREE_MODELS]])
    fitted = dict(zip([*trees, *[n for n in names if n not in TREE_MODELS]], [m for some in fits for m in some]))
    for name, metrics in zip(names, _parallel(lambda n: evaluate(fitted[n], test_m, n), list(names))):
        res.models[name] = fitted[name]
        res.metrics[name] = metrics
    if cv_folds:
        for name, cv in cross_validate_all(list(names), settings, mat.drop("is_test"), cv_folds, seed).items():
            res.metrics[name].update(cv)
    prepared[2].unpersist()
    return res


_parallel = parallel_map


def _fold_weights(x: DataFrame, k: int) -> dict[str, list[Column]]:
    """Weight columns of every fold's training rows for both schemes; 0 for the fold itself.

    ``balanced`` counts classes in the training rows of the fold (one aggregate of k x 2 rows)."""
    counts = {(r["fold"], r[LABEL]): r["n"] for r in x.groupBy("fold", LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted({c for _, c in counts})
    out: dict[str, list[Column]] = {"pos": [], "balanced": []}
    for f in range(k):
        inside = F.col("fold") != f
        n = {c: sum(v for (g, d), v in counts.items() if g != f and d == c) for c in classes}
        balanced = F.lit(0.0)
        for c in classes:
            if n[c]:
                balanced = F.when(F.col(LABEL) == c, F.lit(sum(n.values()) / (2.0 * n[c]))).otherwise(balanced)
        out["balanced"].append(F.when(inside, balanced).otherwise(F.lit(0.0)))
        out["pos"].append(F.when(inside, F.when(F.col(LABEL) == 1, F.lit(float(C.GBT_POS_WEIGHT))).otherwise(F.lit(1.0))).otherwise(F.lit(0.0)))
    return out


def cross_validate_all(names: list[str], settings: dict, mat: DataFrame, k: int = C.CV_FOLDS, seed: int = C.SEED) -> dict[str, dict]:
    """k-fold AUC and F1 (mean, population sd) of several models. The scaler is fitted inside each fold; no SMOTE.

    Each fold is prepared once for the linear model; the folds of all tree models are one joint training
    (trees do not depend on the scale of features, so they read unscaled ones)."""
    x = assembler().transform(folds(mat, k, seed)).withColumnRenamed("raw_features", "__raw").persist(StorageLevel.MEMORY_AND_DISK)
    plain = [n for n in names if n not in TREE_MODELS]
    jobs: list[tuple] = []
    if plain:
        prepared = _parallel(lambda f: prepare_training(x.where(F.col("fold") != f), False, seed), list(range(k)))
        jobs = [(n, f) for n in plain for f in range(k)]

    def boosted() -> list[tuple]:
        chosen, weights = [n for n in names if n in TREE_MODELS], _fold_weights(x, k)
        todo = [(n, settings[n], weights[weight_scheme(n)][f]) for n in chosen for f in range(k)]
        fitted = tree_models(x, todo, vector_to_array("__raw"), "__raw", seed) if todo else []
        return [(n, f, m) for (n, f), m in zip([(n, f) for n in chosen for f in range(k)], fitted)]

    def one(job):
        if job is None:
            return boosted()
        name, f = job
        return [(name, f, fit_prepared(name, settings[name], prepared[f], seed))]

    def judge(fitted):
        name, f, model = fitted
        s = score(model, x.where(F.col("fold") == f)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return name, auc_exact(s), metrics_from_confusion(confusion(s)).first()["f1_score"]
        finally:
            s.unpersist()

    try:
        models = [m for part in _parallel(one, [None, *jobs]) for m in part]
        judged = _parallel(judge, models)
    finally:
        for p in prepared if plain else []:
            p[2].unpersist()
        x.unpersist()

    def mean_sd(v):
        if any(a is None for a in v):  # a fold without both classes has no AUC, and neither has the mean
            return None, None
        mu = sum(v) / len(v)
        return round(mu, 4), round(math.sqrt(sum((a - mu) ** 2 for a in v) / len(v)), 4)

    out = {}
    for name in names:
        (am, asd), (fm, fsd) = mean_sd([a for n, a, _ in judged if n == name]), mean_sd([f1 for n, _, f1 in judged if n == name])
        out[name] = {"cv_auc_mean": am, "cv_auc_std": asd, "cv_f1_mean": fm, "cv_f1_std": fsd}
    return out


def cross_validate(name: str, settings: dict, mat: DataFrame, k: int = C.CV_FOLDS, seed: int = C.SEED) -> dict:
    """``cross_validate_all`` of one model."""
    return cross_validate_all([name], {name: settings}, mat, k, seed)[name]


def random_search(name: str, base: dict, grid: dict, mat: DataFrame, n_iter: int = C.TUNE_ITERATIONS,
                  k: int = C.TUNE_FOLDS, seed: int = C.SEED) -> tuple[dict, float, list]:
    """Seeded sample of grid points, k-fold mean AUC with scaling + SMOTE inside each fold.

    Each fold is scaled and resampled once for all points. The models of a fold are trained together, those
    that differ only in rounds or trees as prefixes of the longest."""
    keys = sorted(grid)
    points = [dict(zip(keys, vals)) for vals in _product([grid[k_] for k_ in keys])]
    rnd = random.Random(seed)
    chosen = rnd.sample(points, min(n_iter, len(points)))
    x = folds(mat, k, seed).persist(StorageLevel.MEMORY_AND_DISK)
    prepared = _parallel(lambda f: prepare_training(x.where(F.col("fold") != f).drop("fold"), True, seed), list(range(k)))

    def auc(f, clf):
        model = PipelineModel(stages=[*prepared[f][:2], clf])
        return auc_exact(score(model, x.where(F.col("fold") == f).drop("fold")))

    length = "n_trees" if name == "RandomForest" else "rounds"

    def rest_of(s):
        return tuple(sorted(((a, b) for a, b in s.items() if a != length), key=lambda v: v[0]))

    def one_fold(f):
        longest: dict = {}
        for p in chosen:
            s = {**base, **p}
            longest[rest_of(s)] = max(longest.get(rest_of(s), 0), s[length])
        w = with_weights(prepared[f][2], weight_scheme(name))
        todo = [(name, {**dict(rest), length: n}, F.col("weight")) for rest, n in longest.items()]
        fitted = dict(zip(longest, tree_models(w, todo, vector_to_array("features"), seed=seed)))
        return _parallel(lambda p: auc(f, fitted[rest_of({**base, **p})].prefix({**base, **p}[length])), chosen)

    try:
        by_fold = [one_fold(f) for f in range(k)]  # the trees of one fold at a time are on the driver
        aucs = [[by_fold[f][i] for f in range(k)] for i in range(len(chosen))]
    finally:
        for p in prepared:
            p[2].unpersist()
        x.unpersist()
    tried = [(p, None if None in a else sum(a) / len(a)) for p, a in zip(chosen, aucs)]
    best = max(tried, key=lambda t: -1.0 if t[1] is None else t[1])  # first wins ties
    return {**base, **best[0]}, best[1], tried


def _product(lists):
    if not lists:
        yield ()
        return
    for v in lists[0]:
        for rest in _product(lists[1:]):
            yield (v, *rest)


def results_frame(spark, metrics: dict) -> DataFrame:
    cols = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "cv_auc_mean", "cv_auc_std"]
    rows = [(name, *[(float(m[c]) if m.get(c) is not None else None) for c in cols]) for name, m in metrics.items()]
    return spark.createDataFrame(rows, "model string, " + ", ".join(f"{c} double" for c in cols))


def metric_winners(results: DataFrame, tol: float = C.METRIC_TIE_TOLERANCE) -> DataFrame:
    """Best value per metric and every model within ``tol`` of it."""
    metrics = [c for c in results.columns if c != "model" and not c.endswith("_std")]
    long = results.unpivot(["model"], metrics, "metric", "value").where(F.col("value").isNotNull())
    best = long.groupBy("metric").agg(F.max("value").alias("best"))
    j = long.join(F.broadcast(best), "metric").where(F.col("value") >= F.col("best") - tol)
    return j.groupBy("metric", "best").agg(F.array_sort(F.collect_list("model")).alias("models"))


def feature_importance(model: PipelineModel, names=C.ML_FEATURES) -> list[tuple[str, float]]:
    clf = model.stages[-1]
    if hasattr(clf, "featureImportances"):
        imp = clf.featureImportances.toArray()
    else:
        imp = [abs(v) for v in clf.coefficients.toArray()]
    return list(zip(list(names), [float(v) for v in imp]))
