"""Hand-made edge frames: constant columns, nulls, bin edges, RAG limits, empty slices."""

import pytest
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.functions.exprs import rag
from churnlake.operators import bins as BN
from churnlake.operators import features as FE
from churnlake.operators import kpi as K
from churnlake.operators.clean import iqr_clip
from churnlake.operators.slicing import slice_filter

BASE_SCHEMA = ("CustomerId long, Surname string, CreditScore int, Geography string, Gender string, Age int, Tenure int, "
               "Balance double, NumOfProducts int, HasCrCard int, IsActiveMember int, EstimatedSalary double, Exited int")


def _base(spark, rows):
    return spark.createDataFrame(rows, BASE_SCHEMA)


def _row(i, age=40, tenure=5, balance=1000.0, products=2, card=1, active=1, credit=600, salary=50000.0, exited=0):
    return (i, f"S{i}", credit, "France", "Male", age, tenure, balance, products, card, active, salary, exited)


def test_constant_columns_normalise_to_zero(spark):
    df = _base(spark, [_row(i) for i in range(4)])
    out = FE.engineer_features(df).collect()
    for r in out:
        assert r["RelationshipStrengthIndex"] == 0.0          # every input constant
        assert r["EngagementScore"] == pytest.approx(0.40 + 0.15)  # active + card, normalised parts 0


@pytest.mark.parametrize("age,segment", [(17, None), (18, 0), (30, 0), (31, 1), (45, 1), (46, 2), (60, 2), (61, 3), (120, 3), (121, None)])
def test_age_segment_edges(spark, age, segment):
    df = _base(spark, [_row(1, age=age), _row(2, age=50)])
    seg = {r["CustomerId"]: r["AgeSegment"] for r in FE.engineer_features(df).collect()}
    assert seg[1] == segment


def test_risk_category_counts_null_as_false_and_caps_at_four(spark):
    df = _base(spark, [_row(1, age=70, tenure=0, balance=0.0, products=4, active=0), _row(2, balance=None), _row(3)])
    r = {x["CustomerId"]: x["ChurnRiskCategory"] for x in FE.engineer_features(df).collect()}
    assert r[1] == 4 and r[2] == 0 and r[3] == 0


@pytest.mark.parametrize("value,lower,compat,expected", [
    (0.70, False, False, C.RAG_GREEN), (0.50, False, False, C.RAG_AMBER), (0.4999, False, False, C.RAG_RED),
    (0.20, True, False, C.RAG_GREEN), (0.35, True, False, C.RAG_AMBER), (0.3501, True, False, C.RAG_RED),
    (0.30, True, True, C.RAG_GREEN),   # original comparison order: amber unreachable
])
def test_rag_limits(spark, value, lower, compat, expected):
    green, amber = (0.20, 0.35) if lower else (0.70, 0.50)
    df = spark.createDataFrame([(value,)], "v double")
    got = df.select(rag(F.col("v"), F.lit(green), F.lit(amber), F.lit(lower), compat).alias("h")).first()["h"]
    assert got == expected


def test_kpis_on_an_empty_slice_do_not_fail(spark):
    df = FE.engineer_features(_base(spark, [_row(i, age=20 + i) for i in range(5)]))
    rep = K.kpi_report(slice_filter(df, geography="Germany")).collect()
    assert len(rep) == 8
    vals = {r["name"]: r["value"] for r in rep}
    assert vals["Engagement Retention Ratio"] is None
    assert vals["Premium Churn Risk Score"] == 0.0   # empty premium segment -> 0


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame([(0, float(v)) for v in [0, 1, 2, 3, 10]], "Exited int, x double")
    h = {r["bin"]: r["count"] for r in BN.equal_width_histogram(df, "x", 5, by=["Exited"]).collect()}
    assert h == {1: 2, 2: 2, 5: 1}


def test_box_whiskers_and_outliers(spark):
    df = spark.createDataFrame([(0, float(v)) for v in [1, 2, 3, 4, 5, 100]], "Exited int, x double")
    b = BN.box_stats(df, "x", by=["Exited"]).first()
    assert (b["q1"], b["median"], b["q3"]) == (2.25, 3.5, 4.75)
    assert (b["whisker_lo"], b["whisker_hi"], b["outliers"]) == (1.0, 5.0, 1)


def test_clip_keeps_nulls_null(spark):
    df = _base(spark, [_row(i, balance=float(i)) for i in range(1, 9)] + [_row(99, balance=None), _row(100, balance=1e9)])
    out = {r["CustomerId"]: r["Balance"] for r in iqr_clip(df).collect()}
    assert out[99] is None
    assert out[100] < 1e9
