"""The end-to-end batch pipeline runs on the smallest fixture and writes every stage."""

import tempfile

from churnlake import config as C
from churnlake.plans.pipeline import run
from churnlake.sources.files import path_exists
from tests.conftest import SF_SMALL


def test_pipeline_small(spark):
    out = tempfile.mkdtemp(prefix="churnlake-pipe-")
    rep = run(spark, out, sf_dir=SF_SMALL, settings=C.MODEL_SETTINGS_LIGHT, cv_folds=C.CV_FOLDS_LIGHT)
    assert rep["validation"]["passed"] is False          # injected duplicates and HasCrCard = 2
    assert "duplicates:None" in rep["validation"]["issues"]
    assert sum(rep["personas"].values()) == 150
    assert len(rep["kpis"]) == 8 and rep["retention"]["total_customers"] == 150
    for stage in ["raw", "clean", "features", "segmented", "retention"]:
        assert path_exists(spark, f"{out}/{stage}/_SUCCESS")
    assert set(rep["models"]) >= {"LogisticRegression", "RandomForest", "GBT_Balanced"}
    again = run(spark, out, sf_dir=SF_SMALL, settings={**C.MODEL_SETTINGS_LIGHT, rep["best_model"]: {**C.MODEL_SETTINGS_LIGHT[rep["best_model"]], "max_depth": 2, "max_iter": 3}}, cv_folds=0)
    assert again["best_model"] != rep["best_model"] or again["explained"] != rep["explained"]  # no explanation of another model
    assert path_exists(spark, f"{out}/shap-{again['explained']}/_SUCCESS")
