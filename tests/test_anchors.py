"""Anchor values published for the sf0.01 fixture (FIXTURES.md, checked independently in DuckDB)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def Q():
    return E.queries()


def test_products_geography_and_risk_categories(spark, Q):
    prod = {r["NumOfProducts"]: r["customers"] for r in Q["eda_products_churn"](spark, SF).collect()}
    assert prod == {1: 844, 2: 359, 3: 178, 4: 119}
    geo = {r["Geography"]: (r["customers"], round(r["churn_rate"], 3)) for r in Q["eda_churn_by_geography"](spark, SF).collect()}
    assert geo == {"France": (588, 0.184), "Germany": (312, 0.256), "Spain": (600, 0.183)}
    risk = {r["risk_code"]: r["customers"] for r in Q["eda_risk_category_churn"](spark, SF).collect()}
    assert risk == {0: 185, 1: 358, 2: 407, 3: 388, 4: 162}


def test_mean_engagement(spark, Q):
    m = Q["feat_engagement"](spark, SF).agg(F.avg("EngagementScore")).first()[0]
    assert m == pytest.approx(0.46345, abs=5e-6)


def test_retention_tiers(spark, Q):
    s = Q["ret_summary"](spark, SF).first()
    assert (s["critical_count"], s["high_count"], s["medium_count"], s["low_count"], s["monitor_count"]) == (410, 252, 349, 138, 351)


def test_kpi_values(spark, Q):
    v = {r["kpi"]: r["value"] for r in Q["kpi_rag_status"](spark, SF).collect()}
    assert v["EngagementRetentionRatio"] == pytest.approx(0.462667, abs=1e-4)
    assert v["ProductDepthIndex_portfolio"] == pytest.approx(0.428667, abs=1e-4)
    assert v["PremiumChurnRiskScore"] == pytest.approx(0.208, abs=1e-4)
    assert v["CreditCardStickinessScore"] == pytest.approx(0.801519, abs=1e-4)
    assert v["BehavioralRiskScore"] == pytest.approx(0.242667, abs=1e-4)


def test_dirty_fixture_counts(spark, Q):
    assert Q["clean_cast_types"](spark, SF).count() == 1516
    dup = Q["val_duplicates"](spark, SF).first()
    assert (dup["n_bad"], dup["severity"]) == (16, "issue")
    nulls = {r["column"]: r["n_bad"] for r in Q["val_nulls"](spark, SF).collect()}
    assert nulls == {"CreditScore": 38, "Balance": 30, "Geography": 33}


def test_fixed_logit_tiers(spark, Q):
    t = {r["risk_tier"]: r["customers"] for r in Q["score_tier_distribution"](spark, SF).collect()}
    assert t == {"LOW": 1495, "MODERATE": 5}
