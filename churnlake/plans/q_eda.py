"""§2.6 grouped and binned analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.operators import eda as EDA
from churnlake.plans import stages
from churnlake.plans.catalog import register
from churnlake.plans.oracle_base import BASE_SQL, with_ctes
from churnlake.plans.oracle_common import D
from churnlake.plans.oracle_features import feat_sql

BASE = (BASE_SQL,)
FEAT = (BASE_SQL, feat_sql("base", "feat"))
RATE = "count(*) AS customers, round(avg(Exited), 6) AS churn_rate"


def age_group_sql(a: str = "Age") -> str:
    e, lab = C.AGE_GROUP_EDGES, C.AGE_GROUP_LABELS
    parts = " ".join(f"WHEN {a} > {lo} AND {a} <= {hi} THEN '{lb}'" for lo, hi, lb in zip(e[:-1], e[1:], lab))
    return f"(CASE {parts} END)"


BAND_SQL = "(CASE WHEN Balance = 0 THEN 'Zero' WHEN Balance < 50000 THEN 'Low' WHEN Balance < 120000 THEN 'Mid' ELSE 'High' END)"


def hist_sql(ctes, src: str, x: str, bins: int, where: str = "TRUE") -> str:
    return with_ctes(
        *ctes,
        f"v AS (SELECT Exited, CAST({x} AS DOUBLE) AS x FROM {src} WHERE {x} IS NOT NULL AND {where})",
        "r AS (SELECT Exited, min(x) AS lo, max(x) AS hi FROM v GROUP BY Exited)",
        f"b AS (SELECT v.Exited, lo, hi, CAST(CASE WHEN hi = lo THEN 1 ELSE least({bins}, CAST(floor((x - lo) * ({D(bins)} / (hi - lo))) AS INTEGER) + 1) END AS INTEGER) AS bin "
        "FROM v JOIN r ON v.Exited IS NOT DISTINCT FROM r.Exited)",
        body=f"SELECT Exited, bin, round(lo + (bin - 1) * ((hi - lo) / {D(bins)}), 6) AS bin_lo, "
             f"round(lo + bin * ((hi - lo) / {D(bins)}), 6) AS bin_hi, count(*) AS count FROM b GROUP BY Exited, bin, lo, hi",
    )


def box_sql(ctes, src: str, x: str) -> str:
    return with_ctes(
        *ctes,
        f"q AS (SELECT Exited, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3 FROM {src} GROUP BY Exited)",
        f"j AS (SELECT s.Exited, CAST({x} AS DOUBLE) AS x, q1, median, q3, "
        f"(CAST({x} AS DOUBLE) >= q1 - {D(1.5)} * (q3 - q1) AND CAST({x} AS DOUBLE) <= q3 + {D(1.5)} * (q3 - q1)) AS inside "
        f"FROM {src} s JOIN q ON s.Exited IS NOT DISTINCT FROM q.Exited)",
        body="SELECT Exited, count(x) AS n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
             "round(min(CASE WHEN inside THEN x END), 6) AS whisker_lo, round(max(CASE WHEN inside THEN x END), 6) AS whisker_hi, "
             "count(*) FILTER (WHERE NOT inside) AS outliers FROM j GROUP BY Exited, q1, median, q3",
    )


@register("eda_churn_distribution", with_ctes(
    *BASE, body="SELECT Exited, CASE WHEN Exited = 1 THEN 'Churned' ELSE 'Retained' END AS label, count(*) AS customers, "
                "round(count(*) / (SELECT count(*) FROM base), 6) AS share FROM base GROUP BY Exited"))
def eda_churn_distribution(spark, sf_dir):
    return EDA.churn_distribution(stages.base(spark, sf_dir))


@register("eda_churn_by_geography", with_ctes(
    *BASE, body=f"SELECT Geography, {RATE}, (SELECT round(avg(Exited), 6) FROM base) AS portfolio_rate FROM base GROUP BY Geography"))
def eda_churn_by_geography(spark, sf_dir):
    return EDA.churn_by_geography(stages.base(spark, sf_dir))


@register("eda_churn_by_gender", with_ctes(*BASE, body=f"SELECT Gender, {RATE} FROM base GROUP BY Gender"))
def eda_churn_by_gender(spark, sf_dir):
    return EDA.churn_rate_by(stages.base(spark, sf_dir), "Gender")


@register("eda_churn_gender_geo_pivot", with_ctes(
    *BASE, body="SELECT Gender, " + ", ".join(
        f"round(avg(Exited) FILTER (WHERE Geography = '{g}'), 6) AS {g}" for g in C.CATEGORICAL_DOMAINS["Geography"])
    + " FROM base GROUP BY Gender"))
def eda_churn_gender_geo_pivot(spark, sf_dir):
    return EDA.gender_geo_pivot(stages.base(spark, sf_dir))


@register("eda_churn_geo_gender", with_ctes(*BASE, body=f"SELECT Geography, Gender, {RATE} FROM base GROUP BY Geography, Gender"))
def eda_churn_geo_gender(spark, sf_dir):
    return EDA.churn_rate_by(stages.base(spark, sf_dir), "Geography", "Gender")


_AGE_ORDER = "CASE age_group " + " ".join(f"WHEN '{lb}' THEN {i}" for i, lb in enumerate(C.AGE_GROUP_LABELS, 1)) + " END"


@register("eda_age_group_churn", with_ctes(
    *BASE, f"a AS (SELECT {age_group_sql()} AS age_group, Exited FROM base)",
    body=f"SELECT age_group, {RATE}, CAST({_AGE_ORDER} AS INTEGER) AS group_order FROM a WHERE age_group IS NOT NULL GROUP BY age_group"))
def eda_age_group_churn(spark, sf_dir):
    return EDA.age_group_churn(stages.base(spark, sf_dir))


@register("eda_age_histogram_by_churn", hist_sql(BASE, "base", "Age", 30))
def eda_age_histogram_by_churn(spark, sf_dir):
    return EDA.histogram_by_class(stages.base(spark, sf_dir), "Age", 30)


@register("eda_age_box_by_churn", box_sql(BASE, "base", "Age"))
def eda_age_box_by_churn(spark, sf_dir):
    return EDA.box_by_class(stages.base(spark, sf_dir), "Age")


@register("eda_balance_box_by_churn", box_sql(BASE, "base", "Balance"))
def eda_balance_box_by_churn(spark, sf_dir):
    return EDA.box_by_class(stages.base(spark, sf_dir), "Balance")


@register("eda_balance_histogram_nonzero", hist_sql(BASE, "base", f"(Balance / {D(1000.0)})", 35, "Balance > 0"))
def eda_balance_histogram_nonzero(spark, sf_dir):
    b = stages.base(spark, sf_dir).where(F.col("Balance") > 0)
    return EDA.histogram_by_class(b, F.col("Balance") / F.lit(1000.0), 35)


@register("eda_zero_balance_churn", with_ctes(
    *BASE, body=f"SELECT CASE WHEN Balance = 0 THEN 'Zero Balance' ELSE 'Has Balance' END AS balance_group, {RATE} FROM base GROUP BY 1"))
def eda_zero_balance_churn(spark, sf_dir):
    return EDA.zero_balance_churn(stages.base(spark, sf_dir))


@register("eda_balance_tercile_churn", with_ctes(
    *BASE,
    f"e AS (SELECT quantile_cont(Balance, {D(1.0 / 3.0)}) AS e1, quantile_cont(Balance, {D(2.0 / 3.0)}) AS e2 FROM base WHERE Balance > 0)",
    "t AS (SELECT CASE WHEN Balance = 0 THEN 'Zero' WHEN Balance <= e1 THEN 'Low' WHEN Balance <= e2 THEN 'Mid' "
    "WHEN Balance > e2 THEN 'High' END AS band, Exited FROM base CROSS JOIN e)",
    body=f"SELECT band, {RATE}, CAST(CASE band WHEN 'Zero' THEN 1 WHEN 'Low' THEN 2 WHEN 'Mid' THEN 3 WHEN 'High' THEN 4 END AS INTEGER) "
         "AS band_order FROM t WHERE band IS NOT NULL GROUP BY band"))
def eda_balance_tercile_churn(spark, sf_dir):
    return EDA.balance_tercile_churn(stages.base(spark, sf_dir))


@register("eda_balance_band_age_heatmap", with_ctes(
    *BASE, f"a AS (SELECT {age_group_sql()} AS age_group, {BAND_SQL} AS band, Exited FROM base)",
    body="SELECT age_group, " + ", ".join(
        f"round(avg(Exited) FILTER (WHERE band = '{b}'), 6) AS {b}" for b in ["Zero", "Low", "Mid", "High"])
    + " FROM a WHERE age_group IS NOT NULL GROUP BY age_group"))
def eda_balance_band_age_heatmap(spark, sf_dir):
    return EDA.balance_band_age_heatmap(stages.base(spark, sf_dir))


@register("eda_age_activity_heatmap", with_ctes(
    *BASE, f"a AS (SELECT {age_group_sql()} AS age_group, IsActiveMember, Exited FROM base)",
    body="SELECT age_group, round(avg(Exited) FILTER (WHERE IsActiveMember = 0), 6) AS inactive, "
         "round(avg(Exited) FILTER (WHERE IsActiveMember = 1), 6) AS active FROM a WHERE age_group IS NOT NULL GROUP BY age_group"))
def eda_age_activity_heatmap(spark, sf_dir):
    return EDA.age_activity_heatmap(stages.base(spark, sf_dir))


@register("eda_tenure_churn", with_ctes(*BASE, body=f"SELECT Tenure, {RATE} FROM base GROUP BY Tenure"))
def eda_tenure_churn(spark, sf_dir):
    return EDA.churn_rate_by(stages.base(spark, sf_dir), "Tenure")


@register("eda_products_churn", with_ctes(*BASE, body=f"SELECT NumOfProducts, {RATE} FROM base GROUP BY NumOfProducts"))
def eda_products_churn(spark, sf_dir):
    return EDA.churn_rate_by(stages.base(spark, sf_dir), "NumOfProducts")


_PROD_LABEL = "CASE NumOfProducts " + " ".join(f"WHEN {i} THEN '{lb}'" for i, lb in enumerate(C.PRODUCT_LABELS, 1)) + " END"


@register("eda_products_activity_churn", with_ctes(
    *BASE, body=f"SELECT {_PROD_LABEL} AS products, CASE IsActiveMember WHEN 1 THEN 'Active' WHEN 0 THEN 'Inactive' END AS activity, "
                f"{RATE} FROM base GROUP BY 1, 2"))
def eda_products_activity_churn(spark, sf_dir):
    return EDA.products_activity_churn(stages.base(spark, sf_dir))


_CARD = "CASE HasCrCard WHEN 1 THEN 'Has Card' WHEN 0 THEN 'No Card' END"


@register("eda_card_share_window", with_ctes(
    *BASE, f"g AS (SELECT {_CARD} AS label, Exited, count(*) AS customers FROM base GROUP BY 1, 2)",
    body=f"SELECT * FROM (SELECT label, Exited, customers, round(customers * {D(100.0)} / sum(customers) OVER (PARTITION BY label), 6) AS pct FROM g) WHERE Exited = 1"))
def eda_card_share_window(spark, sf_dir):
    return EDA.card_share_window(stages.base(spark, sf_dir))


@register("eda_geo_card_churn", with_ctes(
    *BASE, body=f"SELECT Geography, {_CARD} AS card, round(avg(Exited), 6) AS churn_rate FROM base GROUP BY 1, 2"))
def eda_geo_card_churn(spark, sf_dir):
    return EDA.geo_card_churn(stages.base(spark, sf_dir))


_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM feat"
    for a in C.CORRELATION_COLUMNS for b in C.CORRELATION_COLUMNS)


@register("eda_correlation_matrix", with_ctes(*FEAT, body=_CORR))
def eda_correlation_matrix(spark, sf_dir):
    return EDA.correlation_matrix(stages.features(spark, sf_dir))


@register("eda_activity_churn", with_ctes(*BASE, body=f"SELECT IsActiveMember, {RATE} FROM base GROUP BY IsActiveMember"))
def eda_activity_churn(spark, sf_dir):
    return EDA.churn_rate_by(stages.base(spark, sf_dir), "IsActiveMember")


@register("eda_engagement_histogram", hist_sql(FEAT, "feat", "EngagementScore", 30))
def eda_engagement_histogram(spark, sf_dir):
    return EDA.histogram_by_class(stages.features(spark, sf_dir), "EngagementScore", 30)


@register("eda_geo_activity_intensity", with_ctes(
    *FEAT, body="SELECT Geography, round(avg(ActivityIntensityScore), 6) AS mean_activity_intensity FROM feat GROUP BY Geography"))
def eda_geo_activity_intensity(spark, sf_dir):
    return stages.features(spark, sf_dir).groupBy("Geography").agg(
        F.round(F.avg("ActivityIntensityScore"), 6).alias("mean_activity_intensity"))


_RISK = "CASE ChurnRiskCategory " + " ".join(f"WHEN {i} THEN '{lb}'" for i, lb in enumerate(C.RISK_LABELS)) + " END"


@register("eda_risk_category_churn", with_ctes(
    *FEAT, body=f"SELECT ChurnRiskCategory AS risk_code, {_RISK} AS risk, {RATE} FROM feat GROUP BY 1, 2"))
def eda_risk_category_churn(spark, sf_dir):
    return EDA.risk_category_churn(stages.features(spark, sf_dir))


def _credit_sql() -> str:
    step = f"((hi - lo) / {D(8.0)})"
    band = "1 + " + " + ".join(f"CAST(CAST(CreditScore AS DOUBLE) > lo + {D(i)} * {step} AS INTEGER)" for i in range(1, 8))
    return with_ctes(
        *BASE, "r AS (SELECT CAST(min(CreditScore) AS DOUBLE) AS lo, CAST(max(CreditScore) AS DOUBLE) AS hi FROM base)",
        f"b AS (SELECT ({band}) AS band, lo, hi, Exited FROM base CROSS JOIN r)",
        body=f"SELECT band, round(CASE WHEN band = 1 THEN lo - (hi - lo) * {D(0.001)} ELSE lo + (band - 1) * {step} END, 6) AS edge_lo, "
             f"round(lo + band * {step}, 6) AS edge_hi, {RATE} FROM b GROUP BY band, lo, hi")


@register("eda_credit_band_churn", _credit_sql())
def eda_credit_band_churn(spark, sf_dir):
    return EDA.credit_band_churn(stages.base(spark, sf_dir))


_VIOLIN = hist_sql(FEAT, "feat", "ProductUtilizationScore", 50).replace(
    "SELECT Exited, bin, round(", "SELECT * FROM (SELECT Exited, bin, round(", 1) + (
    ") h JOIN (SELECT Exited, round(quantile_cont(ProductUtilizationScore, 0.25), 6) AS q1, "
    "round(quantile_cont(ProductUtilizationScore, 0.5), 6) AS median, round(quantile_cont(ProductUtilizationScore, 0.75), 6) AS q3 "
    "FROM feat GROUP BY Exited) q USING (Exited)")


@register("eda_utilization_violin", _VIOLIN)
def eda_utilization_violin(spark, sf_dir):
    return EDA.utilization_violin(stages.features(spark, sf_dir))


_SCATTER_COLS = ["CustomerId", "LoyaltyScore", "EngagementScore", "Exited"]


@register("eda_scatter_sample", with_ctes(
    *FEAT, body=f"SELECT {', '.join(_SCATTER_COLS)} FROM feat ORDER BY md5(CAST(CustomerId AS VARCHAR) || '{C.SEED}') LIMIT 2000"))
def eda_scatter_sample(spark, sf_dir):
    return EDA.scatter_sample(stages.features(spark, sf_dir), _SCATTER_COLS, 2000)
