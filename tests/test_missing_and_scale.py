"""Missing values, small and odd frames, many groups, hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.functions.stats import exact_quantiles
from churnlake.operators import clean as CL
from churnlake.operators import eda, ml
from churnlake.operators import prep as PR
from churnlake.operators import quality as Q
from churnlake.operators.knn import exact_knn_with_duplicates
from churnlake.operators.smote import smote

NAN = float("nan")


def balances(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "CustomerId long, Balance double")


def test_nan_is_missing(spark):
    df = balances(spark, [10.0, 20.0, 30.0, 40.0, 50.0, 60.0, None, NAN])
    (row,) = [r for r in Q.null_checks(df).collect() if r["column"] == "Balance"]
    assert row.n_bad == 2
    assert Q.range_checks(df).collect() == []
    (row,) = Q.outlier_report(df, ["Balance"]).collect()
    assert (row.z_outliers, row.iqr_outliers, row["mean"], row["max"]) == (0, 0, 35.0, 60.0)
    (row,) = Q.describe_numeric(df, ["Balance"]).collect()
    assert (row["count"], row.p50, row["max"]) == (6, 35.0, 60.0)
    (row,) = [r for r in Q.quality_summary(df).collect() if r["column"] == "Balance"]
    assert (row.null_count, row.unique_values) == (2, 6)
    got = {r.CustomerId: r.Balance for r in CL.impute_median(df).collect()}
    assert got[6] == got[7] == 35.0


@pytest.mark.parametrize("values, skew", [([1.0, 2.0], None), ([5.0] * 6, 0.0), ([1.0], None), ([], None)])
def test_skewness_of_few_or_equal_values(spark, values, skew):
    (row,) = Q.outlier_report(balances(spark, values), ["Balance"]).collect()
    assert row.skewness == skew


def test_all_offending_values_are_listed(spark):
    rows = [(i, f"land{i % 25}", i % 30) for i in range(100)] + [(100, "France", 1)]
    df = spark.createDataFrame(rows, "CustomerId long, Geography string, HasCrCard int")
    found = {r.detail: r.n_bad for r in Q.categorical_checks(df).collect()}
    assert found == {f"land{i}": 4 for i in range(25)}
    assert len(Q.binary_checks(df).collect()) == 28
    report = Q.validation_report(df).collect()
    assert {r.n_rows for r in report} == {101} and sum(r["check"] == "categorical" for r in report) == 25


def test_prep_with_a_column_without_values_and_many_levels(spark):
    rows = [(i, None, float(i), f"g{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "CustomerId long, Age double, Balance double, Geography string")
    out = PR.prep_columns(df, ["Age", "Balance"], ["Geography"])
    assert len(out.columns) == 3 + 1200
    assert out.where(F.col("Age").isNotNull()).count() == 0


def test_correlation_is_pairwise(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame(rng.normal(size=(60, 3)), columns=["Age", "Balance", "Tenure"])
    frame.loc[::3, "Tenure"] = None
    frame["CreditScore"] = 7.0
    df = spark.createDataFrame(frame)
    want = frame.corr()
    for r in eda.correlation_matrix(df, list(frame.columns)).collect():
        w = want.loc[r.col_a, r.col_b]
        assert r["corr"] is None if np.isnan(w) else r["corr"] == pytest.approx(w, abs=1e-6)


@pytest.mark.parametrize("groups", [3, 400])
def test_grouped_quantiles_for_few_and_many_groups(spark, groups):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"g": rng.integers(0, groups, 8000), "x": rng.normal(size=8000).round(2), "y": rng.integers(0, 5, 8000).astype(float)})
    frame.loc[::17, "x"] = None
    frame.loc[frame.g == 1, "y"] = None
    df = spark.createDataFrame(frame).withColumn("g", F.when(F.col("g") != 2, F.col("g")))
    got = exact_quantiles(df, {"a": ("x", 0.1), "m": ("x", 0.5), "z": ("y", 0.9)}, by=["g"], buckets=16, exact_below=8).toPandas()
    frame["g"] = frame.g.where(frame.g != 2)
    want = frame.groupby("g", dropna=False).agg(a=("x", lambda v: v.quantile(0.1)), m=("x", "median"), z=("y", lambda v: v.quantile(0.9))).reset_index()
    got, want = got.sort_values("g").reset_index(drop=True), want.sort_values("g").reset_index(drop=True)
    assert len(got) == len(want) == groups
    for c in ("a", "m", "z"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_folds_are_stratified(spark):
    df = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(1000)], f"{C.ID} long, {C.TARGET} int")
    counts = ml.folds(df, 5).groupBy("fold", C.TARGET).count().collect()
    assert {(r.fold, r[C.TARGET]): r["count"] for r in counts} == {(f, y): n for f in range(5) for y, n in ((0, 196), (1, 4))}


def test_a_hot_vector_among_neighbours(spark):
    """A vector with 200,000 copies next to six others: its copies are never laid out for each neighbour."""
    hot = spark.range(200_000).select(F.col("id"), F.array(F.lit(0.0), F.lit(0.0)).alias("f"))
    others = spark.createDataFrame([(1_000_000 + i, [float(i + 1), 0.0]) for i in range(6)], "id long, f array<double>")
    got = exact_knn_with_duplicates(hot.unionByName(others), 5)
    sizes = got.select(F.size("nb").alias("n")).distinct().collect()
    assert [r.n for r in sizes] == [5]
    first = got.where("id = 1000000").first().nb
    assert first == [[0.0, 0.0]] * 4 + [[2.0, 0.0]] or first[0] in ([0.0, 0.0], [2.0, 0.0])


@pytest.mark.parametrize("kind", ["int", "long"])
def test_synthetic_rows_of_large_ids(spark, kind):
    from pyspark.ml.functions import array_to_vector

    top = 2**31 - 1 if kind == "int" else 2**63 - 1
    rows = [(top - i, int(i < 4), [float(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, f"{C.ID} {kind}, {C.TARGET} int, v array<double>").withColumn("features", array_to_vector("v")).drop("v")
    made = smote(df)
    assert made.count() == int(C.SMOTE_RATIO * 36) - 4 and made.where(F.col(C.ID).isNotNull()).count() == 0


def test_every_feature_has_a_type():
    assert {f for f, _ in C.FEATURE_TYPES} == set(C.ML_FEATURES)


def test_pipeline_folder_of_another_input_is_refused(spark, tmp_path):
    from churnlake.plans.pipeline import _same_input

    (tmp_path / "in.csv").write_text("a")
    out = str(tmp_path / "out")
    _same_input(spark, out, [str(tmp_path / "in.csv")])
    _same_input(spark, out, [str(tmp_path / "in.csv")])
    (tmp_path / "in.csv").write_text("other")
    with pytest.raises(ValueError, match="another input"):
        _same_input(spark, out, [str(tmp_path / "in.csv")])


def test_a_cluster_needs_a_shared_folder():
    from churnlake.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="share"):
        ensure_checkpoint_dir(Session())


def test_quality_summary_counts_clashing_hashes_exactly(spark, monkeypatch):
    rows = [(i % 7, None if i % 5 == 0 else f"text {i % 11}" * 50, float(i % 3) if i % 4 else float("nan")) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(3)
    want = {"a": 7, "b": len({r[1] for r in rows if r[1]}), "c": 3}
    assert {r["column"]: r["unique_values"] for r in Q.exact_distinct(df).collect()} == want
    whole = F.xxhash64

    def poor(*cols):  # the first hash has three values; the second one tells values apart
        return F.pmod(whole(*cols), F.lit(3)) if len(cols) == 1 else whole(*cols)

    monkeypatch.setattr(Q.F, "xxhash64", poor)
    assert {r["column"]: r["unique_values"] for r in Q.exact_distinct(df).collect()} == want


def test_smallest_values_are_in_order_of_numbers(spark):
    df = spark.createDataFrame([(i, f"v{i:02d}", None) for i in (10, 9, 100, 2, 33, 2, 7)], "n long, s string, e double").repartition(2)
    got = {r["column"]: r["sample_values"] for r in Q.smallest_values(df, 3).collect()}
    assert got == {"n": ["2", "7", "9"], "s": ["v02", "v07", "v09"]}
    assert Q.smallest_values(df.limit(0), 3).collect() == []


def test_levels_that_become_columns_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(i, 1.0, f"g{i % 5}") for i in range(20)], "CustomerId long, Age double, Geography string")
    assert [c for c in PR.prep_columns(df, ["Age"], ["Geography"]).columns if c.startswith("Geo")] == [f"Geography_g{i}" for i in range(5)]
    monkeypatch.setattr(C, "MAX_LEVELS", 4)
    with pytest.raises(ValueError, match="levels"):
        PR.prep_columns(df, ["Age"], ["Geography"])
