"""What has to hold for fitted models, checked on whole tables with DuckDB oracles.

Fits cannot be written in SQL, but their results obey facts that can: cells of a confusion matrix add up to the
holdout, every customer is in its nearest cluster and every centre is the mean of its cluster, components are
uncorrelated eigenvectors, resampled rows lie between minority rows, silhouettes follow from sums per cluster.
Each query works these out in Spark from the operators' results for every row; its SQL states what they must be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.operators import explain as X
from churnlake.operators import ml as ML
from churnlake.operators import segment as SG
from churnlake.operators.prep import ml_matrix
from churnlake.operators.smote import smote
from churnlake.plans import q_ml, q_segment, stages
from churnlake.plans.catalog import register
from churnlake.plans.oracle_base import BASE_SQL, with_ctes
from churnlake.plans.oracle_common import D, values_cte
from churnlake.plans.q_ml import FEAT
from churnlake.plans.q_segment import FEATS, SEG_CTES

_MODELS = values_cte("models", ["model"], [(n,) for n in ML.MODEL_NAMES])
_QUOTA = f"floor({D(C.TEST_FRACTION)} * n + {D(0.5)})"
_SPLIT = f"c AS (SELECT Exited, count(*) AS n, CAST({_QUOTA} AS BIGINT) AS held FROM feat GROUP BY Exited)"


# ------------------------------------------------------------------------------------------------ clusters
@register("seg_kmeans_facts", with_ctes(BASE_SQL, body=f"SELECT count(*) AS customers, count(*) AS in_nearest, {C.N_CLUSTERS} AS clusters, "
                                        f"{C.N_CLUSTERS} AS centres_are_means, TRUE AS cost_is_sum, TRUE AS order_is_stable FROM base"))
def seg_kmeans_facts(spark, sf_dir):
    """Of the fitted segmentation: customers in their nearest cluster, clusters whose centre is their mean (to the
    fit's tolerance), and whether the cost is the sum of squared distances."""
    run, cost, order = q_segment._kmeans(spark, sf_dir)
    rows = SG.assign_kmeans(q_segment._scaled(spark, sf_dir), run, order).select("Cluster", F.array(*SG.Z).alias("z"))
    centres = [[float(v) for v in c] for c in run.clusterCenters()]

    def distance(c):
        return F.aggregate(F.zip_with("z", F.array(*[F.lit(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    all_ = F.array(*[distance(c) for c in centres])
    rows = rows.withColumn("all", all_).withColumn("own", F.element_at("all", F.col("Cluster") + 1))
    means = rows.groupBy("Cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("own").alias("cost"), F.count_if(F.col("own") <= F.array_min("all") + 1e-12).alias("near"),
        *[F.avg(F.col("z")[j]).alias(f"m{j}") for j in range(len(SG.Z))])
    wanted = F.element_at(F.array(*[F.array(*[F.lit(v) for v in c]) for c in centres]), F.col("Cluster") + 1)
    moved = reduce(lambda a, b: a + b, [(F.col(f"m{j}") - wanted[j]) ** 2 for j in range(len(SG.Z))])
    return means.agg(
        F.sum("n").alias("customers"), F.sum("near").alias("in_nearest"), F.count(F.lit(1)).cast("int").alias("clusters"),
        F.count_if(F.sqrt(moved) <= 1e-2).cast("int").alias("centres_are_means"), (F.abs(F.sum("cost") - F.lit(cost)) <= 1e-6 * F.lit(cost)).alias("cost_is_sum"),
        F.lit(centres == sorted(centres)).alias("order_is_stable"))


_Z = [f"z_{f}" for f in FEATS]
_SQ = " + ".join(f"{z} * {z}" for z in _Z)
_SIL = (
    "cs AS (SELECT Cluster AS c, count(*) AS n, sum(" + _SQ + ") AS psi, " + ", ".join(f"sum({z}) AS y_{z}" for z in _Z) + " FROM clustered GROUP BY Cluster)",
    "cd AS (SELECT k.CustomerId, k.Cluster, cs.c, cs.n, (k.xi * cs.n + psi - 2 * (" + " + ".join(f"k.{z} * y_{z}" for z in _Z) + ")) / cs.n AS far "
    "FROM (SELECT *, " + _SQ + " AS xi FROM clustered) k CROSS JOIN cs)",
    "cb AS (SELECT CustomerId, max(n) FILTER (WHERE c = Cluster) AS n, max(far) FILTER (WHERE c = Cluster) AS own, min(far) FILTER (WHERE c <> Cluster) AS other FROM cd GROUP BY CustomerId)",
    "ci AS (SELECT CASE WHEN n = 1 THEN 0.0 ELSE (other - own * n / (n - 1)) / greatest(other, own * n / (n - 1)) END AS s FROM cb)",
)


@register("seg_silhouette_fixed", with_ctes(*SEG_CTES[:8], *_SIL, body="SELECT round(avg(s), 6) AS silhouette FROM ci"))
def seg_silhouette_fixed(spark, sf_dir):
    """Silhouette (squared Euclidean, linear in the rows) of the deterministic segmentation."""
    return spark.createDataFrame([(round(SG.silhouette(q_segment._fixed(spark, sf_dir)), 6),)], "silhouette double")


@register("seg_pca_facts", with_ctes(BASE_SQL, body="SELECT count(*) AS customers, TRUE AS centred, TRUE AS uncorrelated, TRUE AS in_order, TRUE AS eigenvectors FROM base"))
def seg_pca_facts(spark, sf_dir):
    """Of the two components: mean 0, no correlation, falling variance, and covariances with the features of the
    length that an eigenvector's have (the squared variance)."""
    rows = SG.pca2(q_segment._scaled(spark, sf_dir))
    got = rows.agg(
        F.count(F.lit(1)).alias("customers"), *[F.avg(f"PCA_{i}").alias(f"m{i}") for i in (1, 2)], F.covar_pop("PCA_1", "PCA_2").alias("c12"),
        *[F.var_pop(f"PCA_{i}").alias(f"v{i}") for i in (1, 2)], *[F.covar_pop(z, f"PCA_{i}").alias(f"c{i}_{j}") for i in (1, 2) for j, z in enumerate(SG.Z)])

    def eigen(i):
        return F.abs(reduce(lambda a, b: a + b, [F.col(f"c{i}_{j}") ** 2 for j in range(len(SG.Z))]) - F.col(f"v{i}") ** 2) <= 1e-9

    return got.select("customers", (F.greatest(F.abs("m1"), F.abs("m2")) <= 1e-9).alias("centred"), (F.abs("c12") <= 1e-9).alias("uncorrelated"),
                      (F.col("v1") >= F.col("v2")).alias("in_order"), (eigen(1) & eigen(2)).alias("eigenvectors"))


# ------------------------------------------------------------------------------------------------ training
@register("ml_smote_facts", with_ctes(
    *FEAT, _SPLIT, "t AS (SELECT max(n - held) AS major, min(n - held) AS minor FROM c)",
    body=f"SELECT greatest(CAST(floor({D(C.SMOTE_RATIO)} * major) AS BIGINT) - minor, 0) AS added, greatest(CAST(floor({D(C.SMOTE_RATIO)} * major) AS BIGINT) - minor, 0) AS inside, "
         "CAST(0 AS BIGINT) AS with_id, CAST(1 AS BIGINT) AS labels FROM t"))
def ml_smote_facts(spark, sf_dir):
    """Of the resampled rows: their number, how many lie within the range of the minority rows in every feature."""
    train = ml_matrix(ML.stratified_split(stages.features(spark, sf_dir)).where(~F.col("is_test")), keep=[C.ID])
    prepared = ML.prepare_training(train, use_smote=False)
    try:
        added = smote(prepared[2]).select(C.ID, C.TARGET, vector_to_array("features").alias("x")).checkpoint(eager=True)
        label = added.agg(F.max(C.TARGET)).first()[0]
        x = vector_to_array("features")
        span = prepared[2].where(F.col(C.TARGET) == F.lit(label)).agg(*[f(x[j]).alias(f"{n}{j}") for j in range(len(C.ML_FEATURES)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    finally:
        prepared[2].unpersist()
    inside = reduce(lambda a, b: a & b, [F.col("x")[j].between(F.lit(span[f"lo{j}"]) - 1e-9, F.lit(span[f"hi{j}"]) + 1e-9) for j in range(len(C.ML_FEATURES))]) if label is not None else F.lit(True)
    return added.agg(F.count(F.lit(1)).alias("added"), F.count_if(inside).alias("inside"), F.count(C.ID).alias("with_id"), F.countDistinct(C.TARGET).alias("labels"))


@register("ml_holdout_facts", with_ctes(
    *FEAT, _SPLIT, _MODELS, body="SELECT model, CAST(sum(held) AS BIGINT) AS customers, CAST(sum(held) FILTER (WHERE Exited = 1) AS BIGINT) AS churned, "
                                 "CAST(sum(held) AS BIGINT) AS in_range, TRUE AS cells_agree, TRUE AS metrics_agree FROM c CROSS JOIN models GROUP BY model"))
def ml_holdout_facts(spark, sf_dir):
    """Every model scored on its holdout again: rows, probabilities in range, and whether cells and metrics are those of its report."""
    res = q_ml.trained(spark, sf_dir)
    out: DataFrame | None = None
    for name in ML.MODEL_NAMES:
        told = res.metrics[name]
        rows = ML.score(res.models[name], res.test)
        cells = rows.agg(
            F.count(F.lit(1)).alias("customers"), F.count_if(F.col(ML.LABEL) == 1).alias("churned"), F.count_if(F.col("prob").between(0, 1)).alias("in_range"),
            *[F.count_if((F.col(ML.LABEL) == a) & (F.col("pred") == p)).alias(n) for n, a, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
        agree = reduce(lambda a, b: a & b, [F.col(n) == F.lit(told[n]) for n in ("tp", "fp", "fn", "tn")])
        rate = [(F.col("tp") + F.col("tn")) / F.col("customers"), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))]
        near = reduce(lambda a, b: a & b, [F.abs(r - F.lit(told[n])) <= 5.1e-5 for r, n in zip(rate, ("accuracy", "precision", "recall"))])
        row = cells.select(F.lit(name).alias("model"), "customers", "churned", "in_range", agree.alias("cells_agree"), near.alias("metrics_agree"))
        out = row if out is None else out.unionByName(row)
    return out


@register("ml_score_facts", with_ctes(BASE_SQL, body="SELECT count(*) AS customers, count(*) AS in_range, count(*) AS labelled, CAST(1 AS BIGINT) AS best_first FROM base"))
def ml_score_facts(spark, sf_dir):
    """Scores of the winner for every customer: in range, predicted by the threshold, and no model with a larger AUC."""
    res = q_ml.trained(spark, sf_dir)
    aucs = [res.metrics[n]["roc_auc"] or -1 for n in ML.MODEL_NAMES]
    best = ML.MODEL_NAMES[aucs.index(max(aucs))]
    rows = ML.score(res.models[best], ml_matrix(stages.features(spark, sf_dir), keep=[C.ID]))
    table = ML.results_frame(spark, res.metrics).orderBy(F.col("roc_auc").desc_nulls_last(), "model")
    first = table.limit(1).where((F.col("model") == best) | (F.col("roc_auc") == max(aucs))).count()
    return rows.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("prob").between(0, 1)).alias("in_range"),
                    F.count_if(F.col("pred") == (F.col("prob") >= 0.5).cast("int")).alias("labelled"), F.lit(first).cast("long").alias("best_first"))


@register("xai_importance_facts", with_ctes(
    BASE_SQL, _MODELS, body=f"SELECT model, CAST({len(C.ML_FEATURES)} AS BIGINT) AS features, TRUE AS not_negative, TRUE AS adds_to_100, CAST({C.IMPORTANCE_TOP} AS BIGINT) AS top_rows FROM models"))
def xai_importance_facts(spark, sf_dir):
    """Importances of every model: one per feature, none negative, percentages that add up."""
    res = q_ml.trained(spark, sf_dir)
    out: DataFrame | None = None
    for name in ML.MODEL_NAMES:
        frame = X.importance_frame(spark, ML.feature_importance(res.models[name]))
        top = X.importance_top(frame).count()
        row = frame.agg(F.countDistinct("feature").alias("features"), F.coalesce(F.min("importance") >= 0, F.lit(False)).alias("not_negative"),
                        F.coalesce(F.abs(F.sum("importance_pct") - 100) <= 0.2, F.sum("importance") == 0).alias("adds_to_100"), F.lit(top).cast("long").alias("top_rows"))
        row = row.select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out
