"""Model-level properties on the smallest fixture."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as E
from churnlake.operators import prep as PR
from churnlake.operators import segment as SG
from churnlake.plans import stages
from churnlake.plans.q_ml import trained
from churnlake.operators.prep import ml_matrix
from tests.conftest import SF_SMALL


def test_kmeans_same_seed_same_cost(spark):
    scaled = SG.scale_features(stages.features(spark, SF_SMALL))
    _m1, c1, o1 = SG.kmeans_best(scaled, restarts=2, max_iter=10)
    _m2, c2, o2 = SG.kmeans_best(scaled, restarts=2, max_iter=10)
    assert c1 == pytest.approx(c2, rel=1e-12) and o1 == o2


def test_saved_model_scores_like_the_fitted_one(spark):
    d = E.queries()["model_save_load"](spark, SF_SMALL)
    assert d.agg(F.max("abs_diff")).first()[0] == 0.0
    assert d.count() == stages.base(spark, SF_SMALL).count()


def test_tree_shap_adds_up_to_the_spark_margin(spark):
    s = E.queries()["xai_tree_shap"](spark, SF_SMALL)
    per = s.groupBy("CustomerId").agg((F.sum("shap_value") + F.first("base_value")).alias("recon"),
                                      F.first("model_output").alias("out"))
    model = trained(spark, SF_SMALL).models["GBT_Balanced"]
    raw = model.transform(ml_matrix(stages.features(spark, SF_SMALL), keep=["CustomerId"])) \
        .select("CustomerId", vector_to_array("rawPrediction")[1].alias("margin"))
    rows = per.join(raw, "CustomerId").collect()
    assert len(rows) == 150
    assert max(abs(r["recon"] - r["out"]) for r in rows) < 1e-9
    assert max(abs(r["out"] - r["margin"]) for r in rows) < 1e-9


def test_spark_ml_prep_pipeline_matches_the_column_form_up_to_the_sd_factor(spark):
    src = stages.base(spark, SF_SMALL)
    cols = PR.prep_columns(src).orderBy("CustomerId").collect()
    model = PR.prep_pipeline().fit(src)
    vecs = model.transform(src).orderBy("CustomerId").select(vector_to_array("features").alias("v")).collect()
    n = len(cols)
    factor = np.sqrt(n / (n - 1))   # Spark scales by the sample sd, the column form by the population sd
    for c, v in zip(cols[:20], vecs[:20]):
        # no nulls in the clean base, so the approximate Imputer is not involved
        assert c["Age"] == pytest.approx(v["v"][1] * factor, rel=1e-9, abs=1e-9)
        assert c["Balance"] == pytest.approx(v["v"][3] * factor, rel=1e-9, abs=1e-9)
