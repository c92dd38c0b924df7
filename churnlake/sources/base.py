"""``customer_base``: the 13-column customer table derived from the test tables.

Grain: one row per customer. ``orders`` is aggregated per customer (partial
aggregation before the shuffle, so a customer holding a large share of the
orders costs one row per map task), then joined 1:1 to ``customer``.
``nation`` is a fixed 25-row dimension and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.sources.tables import read_table

RECENT_FROM = "2000-08-01 00:00:00"
ACTIVE_FROM = "2001-02-01 00:00:00"
MALE_SEGMENTS = ["AUTOMOBILE", "BUILDING", "MACHINERY"]


def _ts(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def order_summary(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
        F.count_if(F.col("o_orderdate") >= _ts(RECENT_FROM)).alias("n_recent"),
        F.count_if(F.col("o_orderdate") >= _ts(ACTIVE_FROM)).alias("n_active"),
    )


def customer_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    orders = read_table(spark, sf_dir, "orders", ["o_custkey", "o_totalprice", "o_orderdate"])
    return derive_base(customer, nation, orders)


def derive_base(customer: DataFrame, nation: DataFrame, orders: DataFrame) -> DataFrame:
    o = order_summary(orders)
    j = (
        customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey, "inner")
        .join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    )
    n_orders = F.coalesce(F.col("n_orders"), F.lit(0))
    cents = F.coalesce(F.col("cents"), F.lit(0)).cast("double")
    n_recent = F.coalesce(F.col("n_recent"), F.lit(0))
    n_active = F.coalesce(F.col("n_active"), F.lit(0))
    key = F.col("c_custkey")
    active = F.when(n_active > 0, 1).otherwise(0)
    age = (F.lit(18) + (key * 37 + F.col("c_nationkey") * 11) % 63).cast("int")
    products = F.least(F.lit(4), F.greatest(F.lit(1), n_recent)).cast("int")
    geography = (
        F.when(F.col("n_regionkey").isin(0, 1), F.lit("France"))
        .when(F.col("n_regionkey") == 2, F.lit("Germany"))
        .otherwise(F.lit("Spain"))
    )
    pts = (
        (F.lit(1) - active) * 2
        + (age > 50).cast("int")
        + (products >= 3).cast("int")
        + (geography == "Germany").cast("int")
    )
    return j.select(
        key.cast("bigint").alias("CustomerId"),
        F.col("c_name").alias("Surname"),
        (F.lit(350) + F.floor(cents / F.greatest(n_orders, F.lit(1)) / F.lit(100000.0))).cast("int").alias("CreditScore"),
        geography.alias("Geography"),
        F.when(F.col("c_mktsegment").isin(*MALE_SEGMENTS), F.lit("Male")).otherwise(F.lit("Female")).alias("Gender"),
        age.alias("Age"),
        F.greatest(F.lit(0), F.least(F.lit(10), n_orders - 5)).cast("int").alias("Tenure"),
        F.when(F.col("c_acctbal") < 2000, F.lit(0.0)).otherwise((F.col("c_acctbal") - F.lit(2000.0)) * F.lit(30.0)).alias("Balance"),
        products.alias("NumOfProducts"),
        F.when((key * 31 + 17) % 97 < 68, 1).otherwise(0).cast("int").alias("HasCrCard"),
        active.cast("int").alias("IsActiveMember"),
        (cents / F.lit(2500.0)).alias("EstimatedSalary"),
        F.when((key * 7919 + 104729) % 1000 < F.lit(40) + F.lit(90) * pts, 1).otherwise(0).cast("int").alias("Exited"),
    )


def dirty_from_base(base: DataFrame) -> DataFrame:
    """Inject nulls, out-of-range values, text variants and exact duplicates."""
    i = F.col("CustomerId")
    geo = F.col("Geography")
    dirty = base.select(
        "CustomerId", "Surname",
        F.when(i % 41 == 0, F.lit(None).cast("int")).otherwise(F.col("CreditScore")).alias("CreditScore"),
        F.when(i % 47 == 0, F.lit(None).cast("string"))
        .when((geo == "Germany") & (i % 3 == 0), F.lit(" germany "))
        .when((geo == "Spain") & (i % 5 == 0), F.lit("SPAIN"))
        .otherwise(geo).alias("Geography"),
        F.when(i % 331 == 0, F.lit("Unknown")).otherwise(F.col("Gender")).alias("Gender"),
        F.when(i % 401 == 0, F.col("Age") + 80).otherwise(F.col("Age")).alias("Age"),
        "Tenure",
        F.when(i % 53 == 0, F.lit(None).cast("double"))
        .when(i % 211 == 0, F.col("Balance") * F.lit(20.0))
        .otherwise(F.col("Balance")).alias("Balance"),
        "NumOfProducts",
        F.when(i % 499 == 0, F.lit(2)).otherwise(F.col("HasCrCard")).alias("HasCrCard"),
        "IsActiveMember", "EstimatedSalary", "Exited",
    )
    return dirty.unionByName(dirty.filter(i % 97 == 0))


def customer_base_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_from_base(customer_base(spark, sf_dir))
