"""Histograms, equal-width bands, quantile bands and box statistics.

Per-class ranges and quartiles are small per-group frames (one row per class)
joined back by broadcast; bin counts are a plain group-by, so nothing is
collected and a hot class costs one partial-aggregate row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.functions.exprs import lit_d
from churnlake.functions.stats import exact_quantiles, null_safe_join


def _grouped(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def equal_width_histogram(df: DataFrame, x: str | Column, bins: int, by: Sequence[str] = (), name: str = "x") -> DataFrame:
    """Equal-width bins over each group's own [min, max]; the last bin is closed.
    Returns by..., bin (1-based), bin_lo, bin_hi, count (non-empty bins only)."""
    by = list(by)
    col = (F.col(x) if isinstance(x, str) else x).cast("double")
    v = df.select(*by, col.alias(name)).where(F.col(name).isNotNull())
    rng = _grouped(v, by, F.min(name).alias("__lo"), F.max(name).alias("__hi"))
    j = null_safe_join(v, rng, by) if by else v.crossJoin(F.broadcast(rng))
    lo, hi = F.col("__lo"), F.col("__hi")
    width = (hi - lo) / lit_d(bins)
    idx = F.when(hi == lo, F.lit(1)).otherwise(
        F.least(F.lit(bins), F.floor((F.col(name) - lo) * (lit_d(bins) / (hi - lo))).cast("int") + 1))
    counted = j.withColumn("bin", idx.cast("int")).groupBy(*by, "bin", "__lo", "__hi").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        *by, "bin",
        F.round(lo + (F.col("bin") - 1) * width, 6).alias("bin_lo"),
        F.round(lo + F.col("bin") * width, 6).alias("bin_hi"),
        "count",
    )


def box_stats(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, median, whiskers (most extreme value within 1.5 IQR) and outlier count per group."""
    by = list(by)
    q = exact_quantiles(df, {"q1": (x, 0.25), "median": (x, 0.5), "q3": (x, 0.75)}, by=by)
    j = null_safe_join(df.select(*by, F.col(x).cast("double").alias("__x")), q, by)
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - lit_d(1.5) * iqr
    hi_f = F.col("q3") + lit_d(1.5) * iqr
    inside = (F.col("__x") >= lo_f) & (F.col("__x") <= hi_f)
    agg = j.groupBy(*by, "q1", "median", "q3").agg(
        F.count("__x").alias("n"),
        F.min(F.when(inside, F.col("__x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"),
    )
    return agg.select(*by, "n", *[F.round(c, 6).alias(c) for c in ["q1", "median", "q3", "whisker_lo", "whisker_hi"]],
                      "outliers")


def equal_width_band(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """``pd.cut(x, bins)`` index 1..bins: right-closed, first edge widened by 0.1% of the range."""
    step = (hi - lo) / lit_d(bins)
    idx = F.lit(1)
    for i in range(1, bins):
        idx = idx + (x > lo + lit_d(i) * step).cast("int")
    return idx
