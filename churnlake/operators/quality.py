"""Validation and data-quality reports.

All per-column checks of one kind are ONE aggregate (conditional counts),
unpivoted to report rows. Offending values are rows with their counts (a
distributed group-by), so no list grows with the data and none is cut. NaN
counts as missing everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake import config as C
from churnlake.functions.exprs import lit_d, present
from churnlake.functions.stats import broadcast_stats, exact_quantiles
from churnlake.functions.tables import small_table

REPORT_SCHEMA = "check string, column string, severity string, n_bad long, pct double, detail string"


def _empty_report(spark) -> DataFrame:
    return small_table(spark, [], REPORT_SCHEMA)


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def required_columns(df: DataFrame) -> DataFrame:
    """Schema-only check: no Spark job."""
    missing = sorted(set(C.REQUIRED_COLUMNS) - set(df.columns))
    rows = [("required_columns", c, "issue", None, None, "missing column") for c in missing]
    return small_table(df.sparkSession, rows, REPORT_SCHEMA)


def null_checks(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).alias("__n")
    wide = df.agg(n, *[F.count_if(present(df, c).isNull()).alias(c) for c in df.columns])
    long = wide.unpivot(["__n"], df.columns, "column", "n_bad")
    pct = F.try_divide(F.col("n_bad"), F.col("__n"))
    return long.where(F.col("n_bad") > 0).select(
        F.lit("nulls").alias("check"), "column",
        F.when(pct > C.NULL_THRESHOLD, "issue").otherwise("warning").alias("severity"),
        F.col("n_bad").cast("long").alias("n_bad"), F.round(pct, 6).alias("pct"), F.lit(None).cast("string").alias("detail"))


def duplicate_rows(df: DataFrame) -> tuple[int, int]:
    """(rows, rows equal to an earlier row); nulls compare equal. Exact, in two steps:
    a 64-bit hash of every row is counted (8 bytes per row, combined map-side);
    only rows whose hash repeats are then grouped by all columns. The candidate
    hashes are broadcast when their number is under BROADCAST_ROW_LIMIT (checked),
    else joined with a shuffle."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    counts = df.select(h.alias("__h")).groupBy("__h").agg(F.count(F.lit(1)).alias("__c"))
    tot = counts.agg(F.sum("__c").alias("n"), F.count_if(F.col("__c") > 1).alias("cand")).first()
    n, n_cand = tot["n"] or 0, tot["cand"] or 0
    if n_cand == 0:
        return n, 0
    cand = counts.where(F.col("__c") > 1).select("__h")
    cand = F.broadcast(cand) if n_cand <= C.BROADCAST_ROW_LIMIT else cand
    rows = df.withColumn("__h", h).join(cand, "__h", "left_semi").drop("__h")
    dup = rows.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c")).agg(F.sum(F.col("__c") - 1)).first()[0]
    return n, int(dup or 0)


def duplicate_check(df: DataFrame) -> DataFrame:
    """Share of rows equal to an earlier row (all columns, nulls equal)."""
    return _duplicate_finding(df, *duplicate_rows(df))


def _duplicate_finding(df: DataFrame, n: int, dup: int) -> DataFrame:
    rows = []
    if dup > 0:
        pct = dup / n
        rows = [("duplicates", None, "issue" if pct > C.DUPLICATE_THRESHOLD else "warning", dup, pct, None)]
    return small_table(df.sparkSession, rows, REPORT_SCHEMA).withColumn("pct", F.round("pct", 6))


def _outside(df: DataFrame, c: str):
    v = present(df, c)
    return (v < C.RANGES[c][0]) | (v > C.RANGES[c][1])


def range_checks(df: DataFrame) -> DataFrame:
    cols = [c for c in C.RANGES if c in df.columns]
    if not cols:
        return _empty_report(df.sparkSession)
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[
        F.count_if(_outside(df, c)).alias(c) for c in cols])
    long = wide.unpivot(["__n"], cols, "column", "n_bad")
    return long.where(F.col("n_bad") > 0).select(
        F.lit("ranges").alias("check"), "column", F.lit("warning").alias("severity"),
        F.col("n_bad").cast("long").alias("n_bad"), F.round(F.try_divide(F.col("n_bad"), F.col("__n")), 6).alias("pct"),
        F.lit(None).cast("string").alias("detail"))


def _offenders_multi(df: DataFrame, specs: Sequence[tuple[str, str, str, object]]) -> DataFrame:
    """One pass for several (check, severity, column, bad-condition) specs: one row per
    offending value (in ``detail``) with the number of rows that have it."""
    items = F.array(*[F.struct(F.lit(chk).alias("check"), F.lit(sev).alias("severity"), F.lit(c).alias("column"),
                               F.col(c).cast("string").alias("value"), cond.alias("bad"))
                      for chk, sev, c, cond in specs])
    pairs = (df.select(F.inline(items)).where(F.col("bad"))
             .groupBy("check", "severity", "column", "value").agg(F.count(F.lit(1)).alias("n")))
    return pairs.select("check", "column", "severity", F.col("n").cast("long").alias("n_bad"),
                        F.lit(None).cast("double").alias("pct"), F.col("value").alias("detail"))


def _binary_specs(df: DataFrame):
    return [("binary", "issue", c, present(df, c).isNotNull() & ~F.col(c).isin(0, 1))
            for c in C.BINARY_COLUMNS if c in df.columns]


def _categorical_specs(df: DataFrame):
    return [("categorical", "warning", c,
             F.col(c).isNotNull() & ~F.col(c).cast("string").isin(*C.CATEGORICAL_DOMAINS[c]))
            for c in C.CATEGORICAL_DOMAINS if c in df.columns]


def binary_checks(df: DataFrame) -> DataFrame:
    specs = _binary_specs(df)
    return _offenders_multi(df, specs) if specs else _empty_report(df.sparkSession)


def categorical_checks(df: DataFrame) -> DataFrame:
    specs = _categorical_specs(df)
    return _offenders_multi(df, specs) if specs else _empty_report(df.sparkSession)


def _counts_checks(df: DataFrame) -> DataFrame:
    """Null and range findings from ONE aggregate of conditional counts."""
    rcols = [c for c in C.RANGES if c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(present(df, c).isNull()).alias(f"nulls|{c}") for c in df.columns],
                  *[F.count_if(_outside(df, c)).alias(f"ranges|{c}") for c in rcols])
    names = [f"nulls|{c}" for c in df.columns] + [f"ranges|{c}" for c in rcols]
    long = wide.unpivot(["__n"], names, "key", "n_bad").where(F.col("n_bad") > 0)
    parts = F.split(F.col("key"), "[|]")
    check, pct = parts[0], F.try_divide(F.col("n_bad"), F.col("__n"))
    severity = (F.when(check == "ranges", "warning")
                .when(pct > C.NULL_THRESHOLD, "issue").otherwise("warning"))
    return long.select(check.alias("check"), parts[1].alias("column"), severity.alias("severity"),
                       F.col("n_bad").cast("long").alias("n_bad"), F.round(pct, 6).alias("pct"),
                       F.lit(None).cast("string").alias("detail"))


def validation_report(df: DataFrame) -> DataFrame:
    """All findings + passed flag (no issue), row count and column count. The input is
    kept for the passes over it: one conditional-count aggregate (nulls, ranges), the
    duplicate check (row hashes, which also count the rows, then rows whose hash
    repeats) and one group-by of the offending values. Findings are checkpointed: the
    summary and the output read them, and the kept input is released."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    specs = _binary_specs(df) + _categorical_specs(df)
    findings = required_columns(df).unionByName(_counts_checks(df))
    n_rows, dup = duplicate_rows(df)
    findings = findings.unionByName(_duplicate_finding(df, n_rows, dup))
    if specs:
        findings = findings.unionByName(_offenders_multi(df, specs))
    findings = findings.checkpoint(eager=True)
    df.unpersist()
    summary = findings.agg(F.coalesce(F.bool_and(F.col("severity") != "issue"), F.lit(True)).alias("passed"))
    return findings.crossJoin(F.broadcast(summary)).select(
        "*", F.lit(n_rows).cast("long").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def exact_distinct(df: DataFrame) -> DataFrame:
    """(column, unique_values): exact number of distinct non-null values of every column, without moving values.

    Rows are (column, 64-bit hash, second 64-bit hash), combined map-side by the first: a column of few values
    is a few rows per task, and a long text costs as much as a number. Where one hash has two second hashes,
    values under it are counted by themselves (none is expected)."""
    cols = df.columns
    items = F.array(*[F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value")) for c in cols])
    long = df.select(F.inline(items)).where(F.col("value").isNotNull()) \
        .select("column", "value", F.xxhash64("value").alias("h"), F.xxhash64(F.lit("second"), F.col("value")).alias("h2"))
    hashes = long.groupBy("column", "h").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi"))
    facts = hashes.groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"), F.sum((F.col("lo") != F.col("hi")).cast("long")).alias("clashes")) \
        .checkpoint(eager=True)                                          # a row per column
    if facts.where("clashes > 0").isEmpty():
        return facts.select("column", "unique_values")
    clashing = hashes.where("lo != hi").select("column", "h")
    more = long.join(clashing, ["column", "h"], "left_semi").groupBy("column").agg(F.countDistinct("h", "value").alias("more"))
    return facts.join(more, "column", "left").select("column", (F.col("unique_values") - F.col("clashes") + F.coalesce("more", F.lit(0))).alias("unique_values"))


def smallest_values(df: DataFrame, samples: int) -> DataFrame:
    """(column, sample_values): the ``samples`` smallest distinct values of every column as strings, numbers by
    value. Each task keeps that many per column; only they are shuffled."""
    cols, num = df.columns, set(_numeric(df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [pa.array([], pa.string())] * len(cols)
        for batch in batches:
            for i, c in enumerate(cols):
                values = pc.unique(pa.concat_arrays([best[i], batch.column(i).cast(pa.string()).drop_null()]))
                order = pa.table({"n": pc.cast(values, pa.float64()) if c in num else pa.nulls(len(values), pa.float64()), "v": values})
                best[i] = pc.take(values, pc.sort_indices(order, sort_keys=[("n", "ascending"), ("v", "ascending")])[:samples])
        for i, values in enumerate(best):
            n = pc.cast(values, pa.float64()) if cols[i] in num else pa.nulls(len(values), pa.float64())
            yield pa.record_batch([pa.array([cols[i]] * len(values), pa.string()), n, values], ["column", "num", "value"])

    kept = df.select(*[present(df, c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)]) \
        .mapInArrow(run, "column string, num double, value string").distinct()
    w = Window.partitionBy("column").orderBy("num", "value")
    return kept.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= samples) \
        .groupBy("column").agg(F.sort_array(F.collect_list(F.struct("__rn", "value"))).alias("__s")) \
        .select("column", F.transform("__s", lambda s: s["value"]).alias("sample_values"))


def quality_summary(df: DataFrame, samples: int = 5, approx_distinct: bool = False) -> DataFrame:
    """Per column: dtype, null count/share, distinct non-null count, 5 smallest distinct values.

    Distinct counts are exact (``exact_distinct``); ``approx_distinct=True`` uses HyperLogLog++
    sketches in one aggregate instead."""
    spark = df.sparkSession
    cols = df.columns
    dtypes = small_table(spark, [(c, t) for c, t in df.dtypes], "column string, dtype string")
    nulls = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(present(df, c).isNull()).alias(c) for c in cols]) \
        .unpivot(["__n"], cols, "column", "null_count")
    if approx_distinct:
        hll = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        uniq = hll.unpivot([], cols, "column", "unique_values")
    else:
        uniq = exact_distinct(df)
    out = (dtypes.join(nulls, "column").join(uniq, "column", "left").join(smallest_values(df, samples), "column", "left"))
    return out.select(
        "column", "dtype", F.col("null_count").cast("long").alias("null_count"),
        F.round(F.try_divide(F.col("null_count") * 100.0, F.col("__n")), 2).alias("null_pct"),
        F.coalesce(F.col("unique_values"), F.lit(0)).cast("long").alias("unique_values"),
        F.concat_ws(", ", "sample_values").alias("sample_values"))


def outlier_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column, over non-null values: |z|>3 (population sd), 1.5 IQR fence, mean,
    sample sd, min, max, bias-adjusted skewness (null below three values, 0 for a
    constant). NaN counts as missing. Two aggregate passes + quartiles."""
    cols = list(cols)
    q = exact_quantiles(df, {**{f"{c}__q1": (c, 0.25) for c in cols}, **{f"{c}__q3": (c, 0.75) for c in cols}})
    aggs = []
    for c in cols:
        x = present(df, c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__sdp"),
                 F.stddev_samp(x).alias(f"{c}__sd"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                 F.skewness(x).alias(f"{c}__g1")]
    stats = df.agg(*aggs).crossJoin(q)
    x = broadcast_stats(df, stats)
    counts = []
    for c in cols:
        v = present(df, c).cast("double")
        z = F.abs(F.try_divide(v - F.col(f"{c}__mean"), F.col(f"{c}__sdp")))
        iqr = F.col(f"{c}__q3") - F.col(f"{c}__q1")
        lo = F.col(f"{c}__q1") - lit_d(C.OUTLIER_IQR_FACTOR) * iqr
        hi = F.col(f"{c}__q3") + lit_d(C.OUTLIER_IQR_FACTOR) * iqr
        counts += [F.count_if(z > C.OUTLIER_Z).alias(f"{c}__z"), F.count_if((v < lo) | (v > hi)).alias(f"{c}__iqr")]
    wide = x.agg(*counts).crossJoin(F.broadcast(stats))
    rows = []
    for c in cols:
        n = F.col(f"{c}__n")
        g1 = F.col(f"{c}__g1")
        adj = F.when(n > 2, F.when(F.col(f"{c}__sdp") == 0, F.lit(0.0)).otherwise(F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)))
        rows.append(F.struct(
            F.lit(c).alias("column"),
            F.col(f"{c}__z").cast("long").alias("z_outliers"),
            F.round(F.try_divide(F.col(f"{c}__z") * 100.0, n), 2).alias("z_outlier_pct"),
            F.col(f"{c}__iqr").cast("long").alias("iqr_outliers"),
            F.round(F.try_divide(F.col(f"{c}__iqr") * 100.0, n), 2).alias("iqr_outlier_pct"),
            F.round(F.col(f"{c}__mean"), 2).alias("mean"),
            F.round(F.col(f"{c}__sd"), 2).alias("std"),
            F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
            F.round(adj, 3).alias("skewness"),
        ))
    return wide.select(F.inline(F.array(*rows)))


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max per column (exact quartiles), 2 digits."""
    cols = list(cols)
    q = exact_quantiles(df, {f"{c}__p{int(p * 100)}": (c, p) for c in cols for p in (0.25, 0.5, 0.75)})
    aggs = []
    for c in cols:
        x = present(df, c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__sd"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs).crossJoin(F.broadcast(q))
    rows = [F.struct(
        F.lit(c).alias("column"), F.col(f"{c}__n").cast("long").alias("count"),
        F.round(F.col(f"{c}__mean"), 2).alias("mean"), F.round(F.col(f"{c}__sd"), 2).alias("std"),
        F.round(F.col(f"{c}__min"), 2).alias("min"), F.round(F.col(f"{c}__p25"), 2).alias("p25"),
        F.round(F.col(f"{c}__p50"), 2).alias("p50"), F.round(F.col(f"{c}__p75"), 2).alias("p75"),
        F.round(F.col(f"{c}__max"), 2).alias("max")) for c in cols]
    return wide.select(F.inline(F.array(*rows)))
