"""§2.5 KPI queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.operators import kpi as K
from churnlake.functions.exprs import rag
from churnlake.operators.slicing import slice_filter
from churnlake.plans import stages
from churnlake.plans.catalog import register
from churnlake.plans.oracle_base import BASE_SQL, with_ctes
from churnlake.plans.oracle_common import values_cte
from churnlake.plans.oracle_features import feat_sql

FEAT_CTES = (BASE_SQL, feat_sql("base", "feat"))

KPI_SQL_EXPR = {
    "EngagementRetentionRatio": "count(*) FILTER (WHERE IsActiveMember = 1 AND Exited = 0) / count(*)",
    "ProductDepthIndex_portfolio": "avg(NumOfProducts) / CAST(4.0 AS DOUBLE)",
    "RelationshipStrengthIndex_avg": "avg(RelationshipStrengthIndex)",
    "PremiumChurnRiskScore": "coalesce(avg(CASE WHEN Balance >= p75 THEN Exited END), CAST(0.0 AS DOUBLE))",
    "CreditCardStickinessScore": "coalesce(avg(CASE WHEN HasCrCard = 1 THEN CAST(Exited = 0 AS INTEGER) END), CAST(0.0 AS DOUBLE))",
    "ActiveLoyaltyIndex": "avg(LoyaltyScore) * avg(IsActiveMember)",
    "CustomerLifetimeStabilityIndicator": "avg(StabilityScore) * (1 - avg(Exited))",
    "BehavioralRiskScore": "count(*) FILTER (WHERE IsActiveMember = 0 AND Balance > p50) / count(*)",
}


def _dim_cte() -> str:
    thr = {k: (g, a, low) for k, g, a, low in C.KPI_THRESHOLDS}
    rows = [(o, k, name, kind, f, i, *thr[k]) for o, k, name, kind, f, i in C.KPI_REPORT]
    return values_cte("kdim", ["kpi_order", "kpi", "name", "kind", "formula", "interpretation", "green", "amber",
                               "lower_is_better"], rows)


def _health(v: str, compat: bool = False) -> str:
    g, a = "green", "amber"
    if compat:
        low = f"CASE WHEN {v} <= {a} THEN '{C.RAG_GREEN}' WHEN {v} <= {g} THEN '{C.RAG_AMBER}' ELSE '{C.RAG_RED}' END"
    else:
        low = f"CASE WHEN {v} <= {g} THEN '{C.RAG_GREEN}' WHEN {v} <= {a} THEN '{C.RAG_AMBER}' ELSE '{C.RAG_RED}' END"
    high = f"CASE WHEN {v} >= {g} THEN '{C.RAG_GREEN}' WHEN {v} >= {a} THEN '{C.RAG_AMBER}' ELSE '{C.RAG_RED}' END"
    return f"(CASE WHEN lower_is_better THEN {low} ELSE {high} END)"


REPORT_SELECT = ("kpi_order, name, round(raw, 4) AS value, "
                 "CASE WHEN kind = 'pct' THEN printf('%.1f%%', round_even(raw * 100, 1)) "
                 "ELSE printf('%.3f', round_even(raw, 3)) END AS display, formula, interpretation, "
                 f"{_health('raw')} AS health")


def kpi_report_sql(src: str, by: list[str] | None = None, where: str = "TRUE", select: str = REPORT_SELECT,
                   kpi_filter: str = "TRUE") -> str:
    by = by or []
    gb = ", ".join(by)
    sel_by = (gb + ", ") if by else ""
    join_q = (" JOIN q USING (" + gb + ")") if by else " CROSS JOIN q"
    vals = ",\n  ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in KPI_SQL_EXPR.items())
    group = f" GROUP BY {gb}" if by else ""
    return with_ctes(
        *FEAT_CTES,
        f"src AS (SELECT * FROM {src} WHERE {where})",
        f"q AS (SELECT {sel_by}quantile_cont(Balance, 0.75) AS p75, quantile_cont(Balance, 0.5) AS p50 FROM src{group})",
        f"v AS (SELECT {sel_by}{vals} FROM src{join_q}{group})",
        f"lng AS (UNPIVOT v ON {', '.join(K.KPI_KEYS)} INTO NAME kpi VALUE raw)",
        _dim_cte(),
        body=f"SELECT {sel_by}{select} FROM lng JOIN kdim USING (kpi) WHERE {kpi_filter}",
    )


def _single(key: str, kpi: str):
    sql = kpi_report_sql("feat", select=f"kpi, round(raw, 4) AS value, {_health('raw')} AS health",
                         kpi_filter=f"kpi = '{kpi}'")

    @register(key, sql)
    def q(spark, sf_dir):
        df = stages.features(spark, sf_dir)
        v = K.kpi_values(df, kpis=[kpi])
        green, amber, lower = next((g, a, low) for k, g, a, low in C.KPI_THRESHOLDS if k == kpi)
        return v.select(
            F.lit(kpi).alias("kpi"), F.round(F.col(kpi), 4).alias("value"),
            rag(F.col(kpi), F.lit(green), F.lit(amber), F.lit(lower)).alias("health"))

    q.__name__ = key


for _k, _kpi in [
    ("kpi_engagement_retention", "EngagementRetentionRatio"),
    ("kpi_product_depth", "ProductDepthIndex_portfolio"),
    ("kpi_relationship_strength", "RelationshipStrengthIndex_avg"),
    ("kpi_premium_churn", "PremiumChurnRiskScore"),
    ("kpi_card_stickiness", "CreditCardStickinessScore"),
    ("kpi_active_loyalty", "ActiveLoyaltyIndex"),
    ("kpi_lifetime_stability", "CustomerLifetimeStabilityIndicator"),
    ("kpi_behavioral_risk", "BehavioralRiskScore"),
]:
    _single(_k, _kpi)


@register("kpi_all", kpi_report_sql("feat"))
def kpi_all(spark, sf_dir):
    return K.kpi_report(stages.features(spark, sf_dir))


_RAG_SQL = kpi_report_sql("feat", select=(
    f"kpi, green, amber, lower_is_better, round(raw, 4) AS value, {_health('raw', True)} AS health_compat, "
    f"{_health('raw')} AS health"))


@register("kpi_rag_status", _RAG_SQL)
def kpi_rag_status(spark, sf_dir):
    """Status under the intended rule and under the original comparison order."""
    df = stages.features(spark, sf_dir)
    v = K.kpi_values(df).unpivot([], K.KPI_KEYS, "kpi", "raw")
    j = v.join(F.broadcast(K.kpi_dimension(spark)), "kpi")
    g, a, low = F.col("green"), F.col("amber"), F.col("lower_is_better")
    return j.select("kpi", "green", "amber", "lower_is_better", F.round("raw", 4).alias("value"),
                    rag(F.col("raw"), g, a, low, compat=True).alias("health_compat"),
                    rag(F.col("raw"), g, a, low).alias("health"))


SLICE = {"geography": "Germany", "gender": None, "age": (30, 60), "tenure": (0, 10)}


@register("kpi_all_by_slice", kpi_report_sql(
    "feat", where="Geography = 'Germany' AND Age BETWEEN 30 AND 60 AND Tenure BETWEEN 0 AND 10"))
def kpi_all_by_slice(spark, sf_dir):
    """Features normalised on the whole portfolio; KPIs (and their percentiles) on the slice."""
    feat = stages.features(spark, sf_dir)
    return K.kpi_report(slice_filter(feat, **SLICE))


@register("kpi_all_by_geography", kpi_report_sql("feat", by=["Geography"]))
def kpi_all_by_geography(spark, sf_dir):
    return K.kpi_report(stages.features(spark, sf_dir), by=["Geography"])
