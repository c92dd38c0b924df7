"""Grouped and binned churn analytics (the data behind every EDA figure and dashboard tab)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.functions.exprs import lit_d, present, r6, right_closed_bin
from churnlake.functions.stats import broadcast_stats, exact_quantiles
from churnlake.operators.bins import box_stats, equal_width_band, equal_width_histogram



def _e() -> Column:
    return F.col("Exited")


def churn_rate_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("customers"), r6(F.avg(_e())).alias("churn_rate"))


def age_group(age: Column | None = None) -> Column:
    return right_closed_bin(age if age is not None else F.col("Age"), C.AGE_GROUP_EDGES, C.AGE_GROUP_LABELS)


def balance_band(b: Column | None = None) -> Column:
    b = b if b is not None else F.col("Balance")
    return (F.when(b == 0, "Zero").when(b < 50000, "Low").when(b < 120000, "Mid").otherwise("High"))


def churn_distribution(df: DataFrame) -> DataFrame:
    g = df.groupBy("Exited").agg(F.count(F.lit(1)).alias("customers"))
    total = g.agg(F.sum("customers").alias("__n"))  # from the grouped counts: the same exchange, no second scan
    return broadcast_stats(g, total).select(
        "Exited", F.when(_e() == 1, "Churned").otherwise("Retained").alias("label"), "customers",
        r6(F.col("customers") / F.col("__n")).alias("share"))


def churn_by_geography(df: DataFrame) -> DataFrame:
    g = df.groupBy("Geography").agg(F.count(F.lit(1)).alias("customers"), F.sum(_e()).alias("s"), F.count(_e()).alias("k"))
    # the portfolio's rate from the grouped sums (a row per country), no second scan
    rows = g.agg(F.collect_list(F.struct("Geography", "customers", "s", "k")).alias("r"), r6(F.sum("s") / F.sum("k")).alias("portfolio_rate"))
    return rows.select(F.inline("r"), "portfolio_rate").select("Geography", "customers", r6(F.col("s") / F.col("k")).alias("churn_rate"), "portfolio_rate")


def gender_geo_pivot(df: DataFrame) -> DataFrame:
    return df.groupBy("Gender").pivot("Geography", C.CATEGORICAL_DOMAINS["Geography"]).agg(r6(F.avg(_e())))


def age_group_churn(df: DataFrame) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in C.AGE_GROUP_LABELS])
    return churn_rate_by(df, age_group().alias("age_group")).where(F.col("age_group").isNotNull()) \
        .withColumn("group_order", F.array_position(labels, F.col("age_group")).cast("int"))


def histogram_by_class(df: DataFrame, x: str | Column, bins: int) -> DataFrame:
    return equal_width_histogram(df, x, bins, by=["Exited"])


def box_by_class(df: DataFrame, x: str) -> DataFrame:
    return box_stats(df, x, by=["Exited"])


def zero_balance_churn(df: DataFrame) -> DataFrame:
    return churn_rate_by(df, F.when(F.col("Balance") == 0, "Zero Balance").otherwise("Has Balance").alias("balance_group"))


def balance_tercile_churn(df: DataFrame) -> DataFrame:
    """Zero balance, then terciles (quantile edges, right-closed) of the non-zero balances."""
    nz = df.where(F.col("Balance") > 0)
    q = exact_quantiles(nz, {"__e1": ("Balance", 1.0 / 3.0), "__e2": ("Balance", 2.0 / 3.0)})
    b = F.col("Balance")
    band = (F.when(b == 0, "Zero").when(b <= F.col("__e1"), "Low").when(b <= F.col("__e2"), "Mid")
            .when(b > F.col("__e2"), "High"))
    x = broadcast_stats(df, q).withColumn("band", band).where(F.col("band").isNotNull())
    order = F.array_position(F.array(*[F.lit(s) for s in ["Zero", "Low", "Mid", "High"]]), F.col("band")).cast("int")
    return churn_rate_by(x, "band").withColumn("band_order", order)


def balance_band_age_heatmap(df: DataFrame) -> DataFrame:
    x = df.withColumn("age_group", age_group()).withColumn("band", balance_band()) \
        .where(F.col("age_group").isNotNull())
    return x.groupBy("age_group").pivot("band", ["Zero", "Low", "Mid", "High"]).agg(r6(F.avg(_e())))


def age_activity_heatmap(df: DataFrame) -> DataFrame:
    x = df.withColumn("age_group", age_group()).where(F.col("age_group").isNotNull())
    p = x.groupBy("age_group").pivot("IsActiveMember", [0, 1]).agg(r6(F.avg(_e())))
    return p.withColumnRenamed("0", "inactive").withColumnRenamed("1", "active")


def products_activity_churn(df: DataFrame) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in C.PRODUCT_LABELS])
    prod = F.element_at(labels, F.col("NumOfProducts"))
    act = F.when(F.col("IsActiveMember") == 1, "Active").when(F.col("IsActiveMember") == 0, "Inactive")
    return churn_rate_by(df, F.when(F.col("NumOfProducts").between(1, 4), prod).alias("products"), act.alias("activity"))


def card_share_window(df: DataFrame) -> DataFrame:
    """Share of each Exited value within the card group; the churned rows are kept.
    The window runs over the (at most 4-row) aggregate, partitioned by label."""
    label = F.when(F.col("HasCrCard") == 1, "Has Card").when(F.col("HasCrCard") == 0, "No Card")
    g = df.groupBy(label.alias("label"), "Exited").agg(F.count(F.lit(1)).alias("customers"))
    w = Window.partitionBy("label")
    return g.withColumn("pct", r6(F.col("customers") * lit_d(100.0) / F.sum("customers").over(w))).where(_e() == 1)


def geo_card_churn(df: DataFrame) -> DataFrame:
    label = F.when(F.col("HasCrCard") == 1, "Has Card").when(F.col("HasCrCard") == 0, "No Card")
    return df.groupBy("Geography", label.alias("card")).agg(r6(F.avg(_e())).alias("churn_rate"))


def pairwise_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of every ordered pair of columns over the rows in which both are present.

    Each batch is a matrix of values (0 where missing) and one of presence; all sums of a batch are five
    products of small matrices, added up in the task and then by pair. Values are taken from a value of
    their column (the smallest of the first rows), so that sums keep their digits and a constant column
    has sums of exactly 0."""
    d = len(cols)
    x = df.select(*[present(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    first = x.limit(1000).agg(*[F.min(c) for c in x.columns]).first()
    centre = np.array([0.0 if v is None or not math.isfinite(v) else v for v in first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, d, d))
        for batch in batches:
            values = np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), float) for i in range(d)], axis=1)
            there = ~np.isnan(values)
            v, m = np.where(there, values - centre, 0.0), there.astype(float)
            sx, sxx = v.T @ m, (v * v).T @ m
            total += np.stack([m.T @ m, sx, sx.T, sxx, sxx.T, v.T @ v])
        i, j = np.divmod(np.arange(d * d, dtype=np.int32), np.int32(max(d, 1)))
        yield pa.record_batch([pa.array(i), pa.array(j), *[pa.array(t.reshape(-1)) for t in total]], ["i", "j", *_MOMENTS])

    sums = x.mapInArrow(run, "i int, j int, " + ", ".join(f"{m} double" for m in _MOMENTS))
    every = df.sparkSession.range(d * d).select(F.expr(f"int(id div {max(d, 1)})").alias("i"), F.expr(f"int(id % {max(d, 1)})").alias("j"))
    return every.join(F.broadcast(sums.groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in _MOMENTS])), ["i", "j"], "left")


_MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def correlation_matrix(df: DataFrame, cols: Sequence[str] = C.CORRELATION_COLUMNS) -> DataFrame:
    """Pearson matrix as long rows (col_a, col_b, corr), pairwise: each pair uses the rows in
    which both are present (NaN is missing). One scan (``pairwise_moments``), no row is collected.
    A constant column gives null."""
    cols = [c for c in cols if c in df.columns]
    spread = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
    corr = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), spread)
    corr = F.when(F.col("i") == F.col("j"), F.when(spread > 0, F.lit(1.0))).otherwise(corr)
    names = F.array(*[F.lit(c) for c in cols])
    return pairwise_moments(df, cols).select(
        F.element_at(names, F.col("i") + 1).alias("col_a"), F.element_at(names, F.col("j") + 1).alias("col_b"), r6(F.when(~F.isnan(corr), corr)).alias("corr"))


def risk_category_churn(df: DataFrame) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in C.RISK_LABELS])
    risk = F.element_at(labels, F.col("ChurnRiskCategory") + 1)
    return churn_rate_by(df, F.col("ChurnRiskCategory").alias("risk_code"), risk.alias("risk"))


def credit_band_churn(df: DataFrame, bins: int = 8) -> DataFrame:
    rng = df.agg(F.min("CreditScore").cast("double").alias("__lo"), F.max("CreditScore").cast("double").alias("__hi"))
    x = broadcast_stats(df, rng)
    lo, hi = F.col("__lo"), F.col("__hi")
    band = equal_width_band(F.col("CreditScore").cast("double"), lo, hi, bins)
    step = (hi - lo) / lit_d(bins)
    g = x.withColumn("band", band).groupBy("band", "__lo", "__hi").agg(
        F.count(F.lit(1)).alias("customers"), r6(F.avg(_e())).alias("churn_rate"))
    edge_lo = F.when(F.col("band") == 1, lo - (hi - lo) * lit_d(0.001)).otherwise(lo + (F.col("band") - 1) * step)
    return g.select("band", r6(edge_lo).alias("edge_lo"), r6(lo + F.col("band") * step).alias("edge_hi"),
                    "customers", "churn_rate")


def utilization_violin(df: DataFrame, bins: int = 50) -> DataFrame:
    """Quartiles per class joined to a 50-bin density of ProductUtilizationScore."""
    h = equal_width_histogram(df, "ProductUtilizationScore", bins, by=["Exited"])
    b = box_stats(df, "ProductUtilizationScore", by=["Exited"]).select("Exited", "q1", "median", "q3")
    return h.join(F.broadcast(b), "Exited")


def scatter_sample(df: DataFrame, cols: Sequence[str], n: int, seed: int = C.SEED) -> DataFrame:
    """Seeded exact-size sample: the n rows with the smallest md5(id || seed) (distributed top-k)."""
    h = F.md5(F.concat(F.col(C.ID).cast("string"), F.lit(str(seed))))
    return df.withColumn("__h", h).orderBy("__h").limit(n).select(*cols)
