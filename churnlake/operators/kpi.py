"""Eight portfolio KPIs with Green/Amber/Red status.

One exact-percentile selection (p75 and p50 of Balance, per group when
grouped) and ONE conditional aggregate compute all eight values; the result is
unpivoted and joined to the fixed 8-row KPI dimension for text and thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake import config as C
from churnlake.functions.exprs import lit_d, rag
from churnlake.functions.stats import exact_quantiles, null_safe_join
from churnlake.functions.tables import small_table

KPI_KEYS = [k for _o, k, *_ in C.KPI_REPORT]


def kpi_dimension(spark) -> DataFrame:
    thr = {k: (g, a, low) for k, g, a, low in C.KPI_THRESHOLDS}
    rows = [(o, k, name, kind, formula, interp, *thr[k]) for o, k, name, kind, formula, interp in C.KPI_REPORT]
    schema = T.StructType([
        T.StructField("kpi_order", T.IntegerType()), T.StructField("kpi", T.StringType()),
        T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()),
        T.StructField("formula", T.StringType()), T.StructField("interpretation", T.StringType()),
        T.StructField("green", T.DoubleType()), T.StructField("amber", T.DoubleType()),
        T.StructField("lower_is_better", T.BooleanType()),
    ])
    return small_table(spark, rows, schema)


def kpi_values(df: DataFrame, by: Sequence[str] = (), kpis: Sequence[str] | None = None) -> DataFrame:
    """One row per group with one double column per KPI key."""
    kpis = list(kpis or KPI_KEYS)
    by = list(by)
    needs_pct = {"PremiumChurnRiskScore", "BehavioralRiskScore"} & set(kpis)
    x = df
    if needs_pct:
        q = exact_quantiles(df, {"__p75": ("Balance", C.KPI_PREMIUM_PERCENTILE),
                                 "__p50": ("Balance", C.KPI_BEHAVIOR_PERCENTILE)}, by=by)
        x = null_safe_join(df, q, by)
    A, E, P, B, CC = (F.col(c) for c in ["IsActiveMember", "Exited", "NumOfProducts", "Balance", "HasCrCard"])
    n = F.count(F.lit(1))
    has = set(df.columns)

    def mean_or_zero(c):
        return F.avg(c) if c in has else F.lit(0.0)

    exprs = {
        "EngagementRetentionRatio": F.try_divide(F.count_if((A == 1) & (E == 0)), n),
        "ProductDepthIndex_portfolio": F.avg(P) / lit_d(C.MAX_PRODUCTS),
        "RelationshipStrengthIndex_avg": mean_or_zero("RelationshipStrengthIndex"),
        "PremiumChurnRiskScore": F.coalesce(F.avg(F.when(B >= F.col("__p75"), E)), lit_d(0.0)) if needs_pct else None,
        "CreditCardStickinessScore": F.coalesce(F.avg(F.when(CC == 1, (E == 0).cast("int"))), lit_d(0.0)),
        "ActiveLoyaltyIndex": (F.avg("LoyaltyScore") * F.avg(A)) if "LoyaltyScore" in has else F.lit(0.0),
        "CustomerLifetimeStabilityIndicator": (F.avg("StabilityScore") * (F.lit(1) - F.avg(E))) if "StabilityScore" in has else F.lit(0.0),
        "BehavioralRiskScore": F.try_divide(F.count_if((A == 0) & (B > F.col("__p50"))), n) if needs_pct else None,
    }
    aggs = [exprs[k].cast("double").alias(k) for k in kpis]
    return x.groupBy(*by).agg(*aggs) if by else x.agg(*aggs)


def kpi_report(df: DataFrame, by: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """``compute_all_kpis``: name, value, display, formula, interpretation, health (+ group keys)."""
    by = list(by)
    wide = kpi_values(df, by)
    long = wide.unpivot(by, KPI_KEYS, "kpi", "raw") if by else wide.unpivot([], KPI_KEYS, "kpi", "raw")
    dim = F.broadcast(kpi_dimension(df.sparkSession))
    j = long.join(dim, "kpi")
    v = F.col("raw")
    display = F.when(F.col("kind") == "pct", F.format_string("%.1f%%", F.bround(v * 100, 1))) \
        .otherwise(F.format_string("%.3f", F.bround(v, 3)))
    return j.select(
        *by, "kpi_order", "name",
        F.round(v, 4).alias("value"),
        display.alias("display"),
        "formula", "interpretation",
        rag(v, F.col("green"), F.col("amber"), F.col("lower_is_better"), compat).alias("health"),
    )
