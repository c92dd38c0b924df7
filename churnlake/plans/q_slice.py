"""§2.7 filters, search, top-k and header metrics."""

from __future__ import annotations

from churnlake import config as C
from churnlake.operators import slicing as S
from churnlake.plans import stages
from churnlake.plans.catalog import register
from churnlake.plans.oracle_base import BASE_SQL, with_ctes
from churnlake.plans.oracle_common import D

BASE = (BASE_SQL,)
SLICE = {"geography": "Germany", "gender": "Female", "age": (25, 60), "tenure": (2, 8)}


@register("slice_filter", with_ctes(
    *BASE, body="SELECT * FROM base WHERE Geography = 'Germany' AND Gender = 'Female' "
                "AND Age BETWEEN 25 AND 60 AND Tenure BETWEEN 2 AND 8"))
def slice_filter(spark, sf_dir):
    return S.slice_filter(stages.base(spark, sf_dir), **SLICE)


@register("slice_domains", with_ctes(
    *BASE, body="SELECT (SELECT list(DISTINCT Geography ORDER BY Geography) FROM base) AS geographies, "
                "(SELECT list(DISTINCT Gender ORDER BY Gender) FROM base) AS genders, "
                "CAST(min(Age) AS INTEGER) AS age_min, CAST(max(Age) AS INTEGER) AS age_max FROM base"))
def slice_domains(spark, sf_dir):
    return S.slice_domains(stages.base(spark, sf_dir))


@register("slice_header", with_ctes(
    *BASE, "s AS (SELECT * FROM base WHERE Age BETWEEN 18 AND 80 AND Tenure BETWEEN 0 AND 10)",
    body="SELECT count(*) AS customers, CAST(coalesce(sum(Exited), 0) AS BIGINT) AS churned, "
         "CAST(count(*) - coalesce(sum(Exited), 0) AS BIGINT) AS retained, round(avg(Exited), 6) AS churn_rate, "
         "round(avg(IsActiveMember), 6) AS active_rate, round(avg(Balance), 6) AS avg_balance, "
         f"round(avg(Exited) - {D(C.CHURN_BENCHMARK)}, 6) AS delta_vs_benchmark FROM s"))
def slice_header(spark, sf_dir):
    return S.slice_header(S.slice_filter(stages.base(spark, sf_dir)))


SEARCH = "00001"


@register("explore_search", with_ctes(
    *BASE, body=f"SELECT * FROM base WHERE regexp_matches(CAST(CustomerId AS VARCHAR), '{SEARCH}') "
                f"OR regexp_matches(Surname, '(?i){SEARCH}')"))
def explore_search(spark, sf_dir):
    return S.explore_search(stages.base(spark, sf_dir), SEARCH)


@register("explore_topk", with_ctes(
    *BASE, body=f"SELECT {', '.join(C.EXPLORER_COLUMNS)} FROM base WHERE Exited = 1 "
                f"ORDER BY Balance DESC, CustomerId LIMIT {C.EXPLORER_LIMIT}"))
def explore_topk(spark, sf_dir):
    return S.explore_topk(stages.base(spark, sf_dir), sort_by="Balance", status="Churned")


@register("customer_lookup", with_ctes(*BASE, body="SELECT * FROM base WHERE CustomerId = 42"))
def customer_lookup(spark, sf_dir):
    return S.customer_lookup(stages.base(spark, sf_dir), 42)
