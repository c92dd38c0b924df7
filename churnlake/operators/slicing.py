"""Interactive slice-and-dice: filters, filter domains, header metrics, search, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.functions.exprs import lit_d


def slice_filter(df: DataFrame, geography: str | None = None, gender: str | None = None,
                 age: tuple[int, int] = C.SLICE_DEFAULT_AGE, tenure: tuple[int, int] = C.SLICE_DEFAULT_TENURE) -> DataFrame:
    """Chained predicates (None = All); ``between`` is inclusive. Pushed to the scan when possible."""
    out = df
    if geography is not None:
        out = out.filter(F.col("Geography").cast("string") == geography)
    if gender is not None:
        out = out.filter(F.col("Gender").cast("string") == gender)
    out = out.filter(F.col("Age").between(age[0], age[1]))
    return out.filter(F.col("Tenure").between(tenure[0], tenure[1]))


def slice_domains(df: DataFrame) -> DataFrame:
    """Filter choices: sorted distinct Geography and Gender, min and max Age, from one
    aggregate (sets are combined in every task first)."""
    level = lambda c: F.array_sort(F.collect_set(F.col(c).cast("string")))
    return df.agg(level("Geography").alias("geographies"), level("Gender").alias("genders"),
                  F.min("Age").cast("int").alias("age_min"), F.max("Age").cast("int").alias("age_max"))


def slice_header(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    churned = F.sum("Exited")
    rate = F.avg("Exited")
    return df.agg(
        n.alias("customers"),
        F.coalesce(churned, F.lit(0)).cast("long").alias("churned"),
        (n - F.coalesce(churned, F.lit(0))).cast("long").alias("retained"),
        F.round(rate, 6).alias("churn_rate"),
        F.round(F.avg("IsActiveMember"), 6).alias("active_rate"),
        F.round(F.avg("Balance"), 6).alias("avg_balance"),
        F.round(rate - lit_d(C.CHURN_BENCHMARK), 6).alias("delta_vs_benchmark"),
    )


def explore_search(df: DataFrame, term: str) -> DataFrame:
    """Id text contains the pattern, or surname contains it case-insensitively (regex)."""
    return df.filter(
        F.col("CustomerId").cast("string").rlike(term)
        | F.col("Surname").cast("string").rlike(f"(?i){term}")
    )


def explore_topk(df: DataFrame, sort_by: str = "Balance", status: str = "All", limit: int = C.EXPLORER_LIMIT) -> DataFrame:
    """Churn-status filter, sort descending (id breaks ties), first ``limit`` rows.
    ``orderBy().limit()`` plans as a distributed TakeOrderedAndProject."""
    out = df
    if status == "Churned":
        out = out.filter(F.col("Exited") == 1)
    elif status == "Retained":
        out = out.filter(F.col("Exited") == 0)
    cols = [c for c in C.EXPLORER_COLUMNS if c in df.columns]
    return out.orderBy(F.col(sort_by).desc(), F.col("CustomerId").asc()).limit(limit).select(*cols)


def customer_lookup(df: DataFrame, customer_id: int) -> DataFrame:
    return df.filter(F.col("CustomerId") == F.lit(customer_id))
