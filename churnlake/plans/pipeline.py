"""End-to-end batch pipeline: validate -> clean -> features -> segments -> KPIs -> models -> explain -> retention.

Each stage is written as a Parquet table under ``out_dir`` (on a cluster: a
shared folder) and read back before the next stage, which cuts the lineage and
lets a failed run resume from the last complete stage. Only small reports
(validation findings, KPIs, model metrics, importances) are collected.

usage: python -m churnlake.plans.pipeline --sf-dir /root/testdata/sf0.1 --out /shared/run1 [--csv raw.csv] [--tune]
"""

from __future__ import annotations

import argparse
import hashlib
import inspect
import json
import time

from pyspark.sql import DataFrame, SparkSession

from churnlake import config as C
from churnlake.operators import boosting as B
from churnlake.operators import clean as CL
from churnlake.operators import explain as X
from churnlake.operators import kpi as K
from churnlake.operators import ml as ML
from churnlake.operators import quality as Q
from churnlake.operators import rules as R
from churnlake.operators import segment as SG
from churnlake.operators.features import engineer_features
from churnlake.operators.prep import ml_matrix
from churnlake.session import ensure_checkpoint_dir
from churnlake.sources import files as IO
from churnlake.plans.stages import INPUTS
from churnlake.sources.base import customer_base_dirty


def _stage(spark: SparkSession, out_dir: str, name: str, compute) -> DataFrame:
    return IO.load_or_compute(spark, f"{out_dir.rstrip('/')}/{name}", compute)


def _model_key(best: str, settings: dict, metrics: dict) -> str:
    """Fingerprint of the model that is explained: its settings and metrics, and the code that trains and explains."""
    h = hashlib.sha1(json.dumps([best, settings.get(best.removesuffix("_Tuned")), metrics[best]], sort_keys=True, default=str).encode())
    for mod in (C, B, ML, X):
        with open(inspect.getsourcefile(mod), "rb") as fh:
            h.update(fh.read())
    return h.hexdigest()[:12]


def _same_input(spark: SparkSession, out_dir: str, paths: list[str]) -> None:
    """Stages in a folder belong to one input: its fingerprint is kept beside them, another one is refused."""
    mark = f"{out_dir.rstrip('/')}/_input"
    now = IO.fingerprint(spark, paths)
    if IO.path_exists(spark, mark):
        if (kept := spark.read.text(mark).first()[0]) != now:
            raise ValueError(f"{out_dir} holds stages of another input ({kept[:8]}, now {now[:8]}); use a new folder")
    else:
        spark.range(1).selectExpr(f"'{now}' AS value").coalesce(1).write.text(mark)


def run(spark: SparkSession, out_dir: str, sf_dir: str | None = None, csv: str | None = None, tune: bool = False,
        settings: dict = C.MODEL_SETTINGS, cv_folds: int = C.CV_FOLDS) -> dict:
    """The whole batch run; ``settings`` and ``cv_folds`` are the full ones unless the caller gives others."""
    t0 = time.time()
    report: dict = {}
    _same_input(spark, out_dir, [csv] if csv else [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in INPUTS])
    raw = IO.read_customers_csv(spark, csv) if csv else customer_base_dirty(spark, sf_dir)
    raw = _stage(spark, out_dir, "raw", lambda: raw)

    findings = Q.validation_report(raw).collect()                      # small: one row per finding
    report["validation"] = {"passed": all(r["severity"] != "issue" for r in findings),
                            "issues": [r["check"] + ":" + str(r["column"]) for r in findings if r["severity"] == "issue"],
                            "warnings": [r["check"] + ":" + str(r["column"]) for r in findings if r["severity"] == "warning"]}

    clean = _stage(spark, out_dir, "clean", lambda: CL.clean(raw))
    feat = _stage(spark, out_dir, "features", lambda: engineer_features(clean))

    seg = _stage(spark, out_dir, "segmented", lambda: SG.segment_customers(feat))
    report["personas"] = {r["Persona"]: r["customers"] for r in SG.persona_counts(seg).collect()}
    report["kpis"] = [r.asDict() for r in K.kpi_report(seg).orderBy("kpi_order").collect()]

    res = ML.train_all(seg, settings=settings, cv_folds=cv_folds)
    if tune:
        for name in C.TUNE_GRIDS:
            best_s, cv_auc, _tried = ML.random_search(name, settings[name], C.TUNE_GRIDS[name], res.train)
            tuned = ML.fit_one(name, best_s, res.train)
            res.models[f"{name}_Tuned"] = tuned
            res.metrics[f"{name}_Tuned"] = {**ML.evaluate(tuned, res.test, f"{name}_Tuned"), "tuned_cv_auc": round(cv_auc, 4)}
    report["models"] = res.metrics
    order = list(res.metrics)
    best = max(order, key=lambda n: (res.metrics[n]["roc_auc"] or -1, -order.index(n)))
    report["best_model"] = best
    for name, model in res.models.items():
        model.write().overwrite().save(f"{out_dir.rstrip('/')}/models/{name}")
    imp = X.importance_frame(spark, ML.feature_importance(res.models[best]))
    report["importance_top"] = [r.asDict() for r in X.importance_top(imp).collect()]
    mat = ml_matrix(seg, keep=[C.ID])
    key = _model_key(best, settings, res.metrics)  # explanations of another model are never reused
    shap = _stage(spark, out_dir, f"shap-{key}", lambda: X.explain_model(res.models[best], mat))
    summary = X.shap_summary(shap)
    report["shap_summary"] = [r.asDict() for r in summary.collect()]
    report["driver_report"] = [r.asDict() for r in X.driver_report(summary).orderBy("rank").collect()]
    _stage(spark, out_dir, f"row_drivers-{key}", lambda: X.row_drivers(shap))
    report["explained"] = key

    retention = _stage(spark, out_dir, "retention", lambda: R.score_customers(R.assign_actions(seg)))
    report["retention"] = R.retention_summary(retention).first().asDict()
    report["elapsed_sec"] = round(time.time() - t0, 1)
    return report


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir")
    ap.add_argument("--csv")
    ap.add_argument("--out", required=True)
    ap.add_argument("--tune", action="store_true")
    a = ap.parse_args()
    # the platform's session: spark-submit decides master, cores and memory
    spark = SparkSession.builder.appName("churnlake").getOrCreate()
    ensure_checkpoint_dir(spark)
    print(json.dumps(run(spark, a.out, a.sf_dir, a.csv, a.tune), default=str, indent=1))


if __name__ == "__main__":
    main()

