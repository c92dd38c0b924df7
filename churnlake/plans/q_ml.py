"""§2.9 machine-learning queries.

Split, folds, class weights and the metric/AUC arithmetic have DuckDB oracles
(the metrics on the deterministic score ChurnRiskCategory / 4). Model fits are
rows-only checks and share one training run per session and input. They run at the full
settings (``config.MODEL_SETTINGS``, 5 folds, 10 search points of 3 folds); a smoke run
may ask for light ones with the session setting ``spark.churnlake.models`` = ``light``.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.operators import ml as ML
from churnlake.operators import rules as R
from churnlake.operators.prep import ml_matrix
from churnlake.operators.smote import smote
from churnlake.plans import stages
from churnlake.plans.catalog import register
from churnlake.plans.oracle_base import BASE_SQL, with_ctes
from churnlake.plans.oracle_common import D
from churnlake.plans.oracle_features import feat_sql
from churnlake.plans.q_rules import PROB_SQL
from churnlake.session import scratch_path

FEAT = (BASE_SQL, feat_sql("base", "feat"))
H_SQL = f"CAST(('0x' || substr(md5(CAST(CustomerId AS VARCHAR) || '{C.SEED}'), 1, 13)) AS BIGINT)"

_CACHE: dict = {}


def light(spark) -> bool:
    """Whether the session asks for light model settings (the default is ``full``)."""
    return spark.conf.get("spark.churnlake.models", "full") == "light"


def model_settings(spark) -> dict:
    return C.MODEL_SETTINGS_LIGHT if light(spark) else C.MODEL_SETTINGS


def _release() -> None:
    """Forgets the last training run, which was on another input, and frees its frames."""
    for res in _CACHE.values():
        if res.matrix is not None:
            res.matrix.unpersist()
    _CACHE.clear()


def trained(spark, sf_dir) -> ML.TrainResult:
    key = (spark.sparkContext.applicationId, sf_dir, stages.key(spark, sf_dir), light(spark))
    if key not in _CACHE:
        _release()
        _CACHE[key] = ML.train_all(stages.features(spark, sf_dir), settings=model_settings(spark))
    return _CACHE[key]


def _metrics_row(spark, name: str, m: dict):
    cols = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]
    return spark.createDataFrame([(name, *[float(m[c]) if m.get(c) is not None else None for c in cols],
                                   int(m["tp"]), int(m["fp"]), int(m["fn"]), int(m["tn"]))],
                                 "model string, " + ", ".join(f"{c} double" for c in cols) + ", tp long, fp long, fn long, tn long")


# ----------------------------------------------------------------------- D oracles
@register("ml_stratified_split", with_ctes(
    *FEAT, f"h AS (SELECT CustomerId, Exited, {H_SQL} AS h FROM feat)",
    "c AS (SELECT Exited, count(*) AS n FROM h GROUP BY Exited)",
    body=f"SELECT CustomerId, Exited, (row_number() OVER (PARTITION BY h.Exited ORDER BY h.h) <= floor({D(C.TEST_FRACTION)} * n + {D(0.5)})) AS is_test "
         "FROM h JOIN c USING (Exited)"))
def ml_stratified_split(spark, sf_dir):
    return ML.stratified_split(stages.features(spark, sf_dir)).select("CustomerId", "Exited", "is_test")


@register("ml_stratified_folds", with_ctes(
    *FEAT, f"h AS (SELECT CustomerId, Exited, {H_SQL} AS h FROM feat)",
    body=f"SELECT CustomerId, Exited, CAST((row_number() OVER (PARTITION BY Exited ORDER BY h) - 1) * {C.CV_FOLDS} "
         f"// count(*) OVER (PARTITION BY Exited) AS INTEGER) AS fold FROM h"))
def ml_stratified_folds(spark, sf_dir):
    return ML.folds(stages.features(spark, sf_dir)).select("CustomerId", "Exited", "fold")


@register("ml_class_weights", with_ctes(
    *FEAT, body="SELECT Exited, count(*) AS customers, round((SELECT count(*) FROM feat) / (2.0 * count(*)), 6) AS weight "
                "FROM feat GROUP BY Exited"))
def ml_class_weights(spark, sf_dir):
    return ML.class_weights(stages.features(spark, sf_dir))


def score_risk():
    return F.col("ChurnRiskCategory") / F.lit(4.0)



SCORE_RISK_SQL = f"(ChurnRiskCategory / {D(4.0)})"


@register("ml_confusion", with_ctes(
    *FEAT, body=f"SELECT Exited AS actual, CAST({SCORE_RISK_SQL} >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM feat GROUP BY 1, 2"))
def ml_confusion(spark, sf_dir):
    s = stages.features(spark, sf_dir).withColumn("score", score_risk())
    return ML.confusion(s, "score")


_METRICS_SQL = with_ctes(
    *FEAT,
    f"c AS (SELECT count(*) FILTER (WHERE Exited = 1 AND {SCORE_RISK_SQL} >= 0.5) AS tp, "
    f"count(*) FILTER (WHERE Exited = 0 AND {SCORE_RISK_SQL} >= 0.5) AS fp, "
    f"count(*) FILTER (WHERE Exited = 1 AND {SCORE_RISK_SQL} < 0.5) AS fn, "
    f"count(*) FILTER (WHERE Exited = 0 AND {SCORE_RISK_SQL} < 0.5) AS tn FROM feat)",
    body="SELECT tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, "
         "round(coalesce(tp / nullif(tp + fp, 0), 0.0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 4) AS recall, "
         "round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 4) AS f1_score FROM c")


@register("ml_metrics", _METRICS_SQL)
def ml_metrics(spark, sf_dir):
    s = stages.features(spark, sf_dir).withColumn("score", score_risk())
    return ML.metrics_from_confusion(ML.confusion(s, "score"))


def _auc_sql(score_sql: str, name: str, src: str) -> str:
    return (f"(SELECT '{name}' AS score_name, round(sum(pos * (coalesce(neg_below, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc "
            f"FROM (SELECT s, pos, neg, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_below "
            f"FROM (SELECT {score_sql} AS s, sum(Exited) AS pos, count(*) - sum(Exited) AS neg FROM {src} GROUP BY 1)))")


@register("ml_auc_exact", with_ctes(
    *FEAT, body=_auc_sql(SCORE_RISK_SQL, "risk_category", "feat") + " UNION ALL " + _auc_sql(PROB_SQL, "fixed_logit", "feat")))
def ml_auc_exact(spark, sf_dir):
    f = stages.features(spark, sf_dir)
    a1 = ML.auc_exact(f.withColumn("score", score_risk()), "score")
    a2 = ML.auc_exact(f.withColumn("score", R.churn_probability()), "score")
    return spark.createDataFrame([("risk_category", round(a1, 6)), ("fixed_logit", round(a2, 6))], "score_name string, auc double")


# ----------------------------------------------------------------------- rows-only
@register("ml_smote")
def ml_smote(spark, sf_dir):
    """Synthetic minority rows for the scaled training split (count = 0.75 x majority - minority)."""
    from pyspark.ml.feature import StandardScaler

    res_train = ML.stratified_split(stages.features(spark, sf_dir))
    train = ml_matrix(res_train.where(~F.col("is_test")), keep=[C.ID])
    asm = ML.assembler().transform(train)
    scaled = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True).fit(asm) \
        .transform(asm).select(C.ID, C.TARGET, "features")
    syn = smote(scaled)
    return syn.select(C.ID, C.TARGET, vector_to_array("features").alias("features"))


def _model_query(key: str, name: str):
    @register(key)
    def q(spark, sf_dir):
        return _metrics_row(spark, name, trained(spark, sf_dir).metrics[name])

    q.__name__ = key


for _k, _n in [("ml_logistic", "LogisticRegression"), ("ml_decision_tree", "DecisionTree"),
               ("ml_random_forest", "RandomForest"), ("ml_gbt_a", "GBT_LevelWise"), ("ml_gbt_b", "GBT_Balanced")]:
    _model_query(_k, _n)


@register("ml_train_all")
def ml_train_all(spark, sf_dir):
    return ML.results_frame(spark, trained(spark, sf_dir).metrics)


@register("ml_results_table")
def ml_results_table(spark, sf_dir):
    return ML.results_frame(spark, trained(spark, sf_dir).metrics).orderBy(F.col("roc_auc").desc_nulls_last(), "model")


@register("ml_best_model")
def ml_best_model(spark, sf_dir):
    res = trained(spark, sf_dir)
    best = None
    for name in ML.MODEL_NAMES:  # registry order: the first wins a tie
        auc = res.metrics[name]["roc_auc"]
        if auc is not None and (best is None or auc > best[1]):
            best = (name, auc)
    return spark.createDataFrame([best], "model string, roc_auc double")


@register("ml_metric_winners")
def ml_metric_winners(spark, sf_dir):
    return ML.metric_winners(ML.results_frame(spark, trained(spark, sf_dir).metrics))


@register("ml_score")
def ml_score(spark, sf_dir):
    """P(churn) of the best model for every customer (whole table)."""
    res = trained(spark, sf_dir)
    best = max(ML.MODEL_NAMES, key=lambda n: (res.metrics[n]["roc_auc"] or -1, -ML.MODEL_NAMES.index(n)))
    mat = ml_matrix(stages.features(spark, sf_dir), keep=[C.ID])
    return ML.score(res.models[best], mat).select(C.ID, "prob", "pred")


@register("ml_cross_validate")
def ml_cross_validate(spark, sf_dir):
    mat = ml_matrix(stages.features(spark, sf_dir), keep=[C.ID])
    found = ML.cross_validate_all(ML.MODEL_NAMES, model_settings(spark), mat, k=C.CV_FOLDS_LIGHT if light(spark) else C.CV_FOLDS)
    rows = [(name, cv["cv_auc_mean"], cv["cv_auc_std"], cv["cv_f1_mean"], cv["cv_f1_std"]) for name, cv in found.items()]
    return spark.createDataFrame(rows, "model string, cv_auc_mean double, cv_auc_std double, cv_f1_mean double, cv_f1_std double")


def _search(spark, sf_dir, name: str):
    res = trained(spark, sf_dir)
    grid, n_iter, k = ((C.TUNE_GRIDS_LIGHT, C.TUNE_ITERATIONS_LIGHT, C.TUNE_FOLDS_LIGHT) if light(spark)
                       else (C.TUNE_GRIDS, C.TUNE_ITERATIONS, C.TUNE_FOLDS))
    best, _auc, tried = ML.random_search(name, model_settings(spark)[name], grid[name], res.train, n_iter=n_iter, k=k)
    rows = [(str(sorted(p.items(), key=lambda v: v[0])), None if a is None else float(a), p == {k: best[k] for k in p}) for p, a in tried]
    return spark.createDataFrame(rows, "params string, cv_auc double, chosen boolean")


@register("ml_tune_random_search")
def ml_tune_random_search(spark, sf_dir):
    return _search(spark, sf_dir, "RandomForest")


@register("ml_tune_boosting")
def ml_tune_boosting(spark, sf_dir):
    """The same search for the level-wise booster."""
    return _search(spark, sf_dir, "GBT_LevelWise")


@register("model_save_load", with_ctes(*FEAT, body=f"SELECT CustomerId, {D(0.0)} AS abs_diff FROM feat"))
def model_save_load(spark, sf_dir):
    """Save the fitted pipeline, load it back, score: the difference per row must be 0."""
    res = trained(spark, sf_dir)
    model = res.models["RandomForest"]
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    mat = ml_matrix(stages.features(spark, sf_dir), keep=[C.ID])
    a = ML.score(model, mat).select(*mat.columns, F.col("prob").alias("p_saved"))
    b = ML.score(loaded, a)  # both scores row by row, no join
    return b.select(C.ID, F.abs(F.col("p_saved") - F.col("prob")).alias("abs_diff"))
