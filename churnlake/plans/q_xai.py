"""§2.10 explainability queries.

Linear SHAP (on the linear terms of the fixed logit), its summary, per-row
drivers and the driver report have DuckDB oracles. Importances and TreeSHAP
come from the fitted models (rows-only checks).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.operators import explain as X
from churnlake.operators import ml as ML
from churnlake.operators.prep import ml_matrix
from churnlake.plans import stages
from churnlake.plans.catalog import register
from churnlake.plans.oracle_base import BASE_SQL, with_ctes
from churnlake.plans.oracle_common import D, values_cte
from churnlake.plans.q_ml import trained

COEFS = C.LINEAR_SHAP_COEFS


def _geo(df):
    return df.withColumns({"Geo_Germany": (F.col("Geography") == "Germany").cast("int"),
                           "Geo_Spain": (F.col("Geography") == "Spain").cast("int")})


def linear_long(spark, sf_dir):
    return X.linear_shap(_geo(stages.base(spark, sf_dir)), COEFS)


_LIN_CTES = (
    BASE_SQL,
    "g AS (SELECT *, CAST(Geography = 'Germany' AS INTEGER) AS Geo_Germany, CAST(Geography = 'Spain' AS INTEGER) AS Geo_Spain FROM base)",
    "m AS (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m{i}" for i, (c, _b) in enumerate(COEFS)) + " FROM g)",
    "lin AS (" + " UNION ALL ".join(
        f"SELECT CustomerId, {i} AS pos, '{c}' AS feature, CAST({c} AS DOUBLE) AS feature_value, "
        f"{D(b)} * (CAST({c} AS DOUBLE) - m{i}) AS shap_value FROM g CROSS JOIN m" for i, (c, b) in enumerate(COEFS)) + ")",
)
_SUMMARY_CTE = ("summ AS (SELECT feature, round(mean_abs_shap, 6) AS mean_abs_shap, "
                "CAST(row_number() OVER (ORDER BY mean_abs_shap DESC, feature) AS INTEGER) AS rank FROM "
                f"(SELECT feature, avg(abs(shap_value)) AS mean_abs_shap FROM lin GROUP BY feature) ORDER BY mean_abs_shap DESC, feature LIMIT {C.SHAP_TOP})")


@register("xai_linear_shap", with_ctes(*_LIN_CTES, body="SELECT CustomerId, feature, feature_value, round(shap_value, 6) AS shap_value FROM lin"))
def xai_linear_shap(spark, sf_dir):
    return linear_long(spark, sf_dir).select("CustomerId", "feature", "feature_value", F.round("shap_value", 6).alias("shap_value"))


@register("xai_shap_summary", with_ctes(*_LIN_CTES, _SUMMARY_CTE, body="SELECT * FROM summ"))
def xai_shap_summary(spark, sf_dir):
    return X.shap_summary(linear_long(spark, sf_dir))


@register("xai_row_drivers", with_ctes(
    *_LIN_CTES,
    body="SELECT CustomerId, CAST(rank AS INTEGER) AS rank, feature, round(feature_value, 6) AS feature_value, round(shap_value, 6) AS shap_value, "
         f"CASE WHEN shap_value > 0 THEN '{C.DIRECTION_UP}' ELSE '{C.DIRECTION_DOWN}' END AS direction FROM "
         "(SELECT *, row_number() OVER (PARTITION BY CustomerId ORDER BY abs(shap_value) DESC, pos) AS rank FROM lin) "
         f"WHERE rank <= {C.ROW_DRIVERS_TOP}"))
def xai_row_drivers(spark, sf_dir):
    return X.linear_row_drivers(_geo(stages.base(spark, sf_dir)), COEFS)


@register("xai_driver_report", with_ctes(
    *_LIN_CTES, _SUMMARY_CTE, values_cte("narr", ["feature", "narrative"], list(C.DRIVER_NARRATIVES)),
    body=f"SELECT rank, feature, mean_abs_shap, coalesce(narrative, '{C.DEFAULT_NARRATIVE}') AS narrative "
         f"FROM summ LEFT JOIN narr USING (feature) WHERE rank <= {C.DRIVER_REPORT_TOP}"))
def xai_driver_report(spark, sf_dir):
    return X.driver_report(X.shap_summary(linear_long(spark, sf_dir)))


# ----------------------------------------------------------------------- rows-only
def _best(spark, sf_dir):
    res = trained(spark, sf_dir)
    name = max(ML.MODEL_NAMES, key=lambda n: (res.metrics[n]["roc_auc"] or -1, -ML.MODEL_NAMES.index(n)))
    return name, res.models[name]


def _importance(spark, sf_dir):
    _name, model = _best(spark, sf_dir)
    return X.importance_frame(spark, ML.feature_importance(model))


@register("xai_feature_importance")
def xai_feature_importance(spark, sf_dir):
    return _importance(spark, sf_dir)


@register("xai_importance_top15")
def xai_importance_top15(spark, sf_dir):
    return X.importance_top(_importance(spark, sf_dir))


@register("xai_importance_by_type")
def xai_importance_by_type(spark, sf_dir):
    return X.importance_by_type(_importance(spark, sf_dir))


@register("xai_tree_shap")
def xai_tree_shap(spark, sf_dir):
    """Path-dependent TreeSHAP of the leaf-wise booster's margin for every customer."""
    model = trained(spark, sf_dir).models["GBT_Balanced"]
    mat = ml_matrix(stages.features(spark, sf_dir), keep=[C.ID])
    return X.tree_shap_frame(model, mat)


# --------------------------------------------------------- the model that won
def _best_shap(spark, sf_dir):
    _name, model = _best(spark, sf_dir)
    return X.explain_model(model, ml_matrix(stages.features(spark, sf_dir), keep=[C.ID]))


@register("xai_best_shap_summary")
def xai_best_shap_summary(spark, sf_dir):
    return X.shap_summary(_best_shap(spark, sf_dir))


@register("xai_best_row_drivers")
def xai_best_row_drivers(spark, sf_dir):
    return X.row_drivers(_best_shap(spark, sf_dir))


@register("xai_best_driver_report")
def xai_best_driver_report(spark, sf_dir):
    return X.driver_report(X.shap_summary(_best_shap(spark, sf_dir)))


@register("xai_shap_additivity", with_ctes(
    BASE_SQL, values_cte("models", ["model"], [(n,) for n in ML.MODEL_NAMES]),
    body=f"SELECT CustomerId, model, {D(0.0)} AS gap FROM base CROSS JOIN models"))
def xai_shap_additivity(spark, sf_dir):
    """For every customer and every fitted model: base value + SHAP values = model output."""
    res, mat = trained(spark, sf_dir), ml_matrix(stages.features(spark, sf_dir), keep=[C.ID])
    out = None
    for name in ML.MODEL_NAMES:
        gap = X.additivity_gap(X.explain_model(res.models[name], mat)).select(C.ID, F.lit(name).alias("model"), F.abs(F.round("gap", 6)).alias("gap"))
        out = gap if out is None else out.unionByName(gap)
    return out
