"""§2.4 feature queries."""

from __future__ import annotations

from churnlake.operators.features import normalise
from churnlake.plans import stages
from churnlake.plans.catalog import register
from churnlake.plans.oracle_base import BASE_SQL, with_ctes
from churnlake.plans.oracle_features import _n, feat_sql

FEAT_CTES = (BASE_SQL, feat_sql("base", "feat"))

NORM_COLS = ["Tenure", "NumOfProducts", "Balance", "CreditScore", "EstimatedSalary"]
_norm_stats = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in NORM_COLS)
_norm_sel = ", ".join(f"{_n(c, c, 's')} AS {c}_norm" for c in NORM_COLS)


@register("feat_minmax_norm", with_ctes(BASE_SQL, body=f"SELECT CustomerId, {_norm_sel} FROM base CROSS JOIN (SELECT {_norm_stats} FROM base) s"))
def feat_minmax_norm(spark, sf_dir):
    out = normalise(stages.base(spark, sf_dir), NORM_COLS)
    return out.select("CustomerId", *[f"{c}_norm" for c in NORM_COLS])


def _feature_query(key: str, column: str):
    sql = with_ctes(*FEAT_CTES, body=f"SELECT CustomerId, {column} FROM feat")

    @register(key, sql)
    def q(spark, sf_dir):
        return stages.features(spark, sf_dir).select("CustomerId", column)

    q.__name__ = key
    return q


for _key, _col in [
    ("feat_engagement", "EngagementScore"),
    ("feat_relationship_strength", "RelationshipStrengthIndex"),
    ("feat_product_utilization", "ProductUtilizationScore"),
    ("feat_loyalty", "LoyaltyScore"),
    ("feat_premium_risk", "PremiumRiskScore"),
    ("feat_financial_commitment", "FinancialCommitmentIndex"),
    ("feat_activity_intensity", "ActivityIntensityScore"),
    ("feat_product_depth", "ProductDepthIndex"),
    ("feat_stability", "StabilityScore"),
    ("feat_churn_risk_category", "ChurnRiskCategory"),
    ("feat_balance_salary_ratio", "BalanceSalaryRatio"),
    ("feat_age_segment", "AgeSegment"),
]:
    _feature_query(_key, _col)


@register("feat_all", with_ctes(*FEAT_CTES, body="SELECT * FROM feat"))
def feat_all(spark, sf_dir):
    return stages.features(spark, sf_dir)

