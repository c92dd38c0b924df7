"""Cleaning: dedupe -> impute (median / mode) -> IQR clip -> text standardise -> cast.

Statistics are gathered in few jobs (null counts, exact medians, modes, fences)
and applied as literals/broadcast columns; the data itself is never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake import config as C
from churnlake.functions.exprs import lit_d, present
from churnlake.functions.stats import exact_quantiles

EXCLUDE_FROM_IMPUTE = {C.ID, C.TARGET}


def dedupe(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (nulls equal). Exact and without shuffling every row:
    a 64-bit row hash is counted first (8 bytes per row, combined map-side); rows with
    a unique hash cannot have a copy and pass through in place; only rows whose hash
    repeats are de-duplicated by all columns. Above BROADCAST_ROW_LIMIT candidate
    hashes (checked) it falls back to a plain ``dropDuplicates``."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    counts = df.select(h.alias("__h")).groupBy("__h").agg(F.count(F.lit(1)).alias("__c"))
    cand = counts.where(F.col("__c") > 1).select("__h")
    n_cand = cand.count()
    if n_cand == 0:
        return df
    if n_cand > C.BROADCAST_ROW_LIMIT:
        return df.dropDuplicates()
    keyed = df.withColumn("__h", h)
    single = keyed.join(F.broadcast(cand), "__h", "left_anti").drop("__h")
    repeated = keyed.join(F.broadcast(cand), "__h", "left_semi").drop("__h").dropDuplicates()
    return single.unionByName(repeated)


def _null_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    if not cols:
        return {}
    row = df.agg(*[F.count_if(present(df, c).isNull()).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def impute_median(df: DataFrame, nulls: dict[str, int] | None = None) -> DataFrame:
    """Numeric columns with nulls or NaN (id and target excluded) <- exact median; a column
    without any value stays as it is."""
    cand = [c for c in numeric_columns(df) if c not in EXCLUDE_FROM_IMPUTE]
    nulls = nulls if nulls is not None else _null_counts(df, cand)
    todo = [c for c in cand if nulls[c] > 0]
    if not todo:
        return df
    med = exact_quantiles(df, {c: (c, 0.5) for c in todo}).first()
    return df.withColumns({c: F.coalesce(present(df, c).cast("double"), lit_d(med[c])) for c in todo if med[c] is not None})


def column_mode(df: DataFrame, c: str):
    """Most frequent non-null value; ties -> smallest. Distributed group count + top-1."""
    top = (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
           .orderBy(F.col("__n").desc(), F.col(c).asc()).limit(1).collect())
    return top[0][c] if top else None


def impute_mode(df: DataFrame, nulls: dict[str, int] | None = None) -> DataFrame:
    cand = text_columns(df)
    nulls = nulls if nulls is not None else _null_counts(df, cand)
    fills = {}
    for c in cand:
        if nulls[c] > 0:
            m = column_mode(df, c)
            if m is not None:
                fills[c] = F.coalesce(F.col(c), F.lit(m))
    return df.withColumns(fills) if fills else df


def iqr_clip(df: DataFrame, factor: float = C.CLIP_IQR_FACTOR) -> DataFrame:
    """Clip to [Q1 - f*IQR, Q3 + f*IQR] (exact quartiles, one selection job).
    Clipped columns are always double, so the schema does not depend on the data;
    nulls stay null (``greatest``/``least`` would otherwise turn them into a bound)."""
    cols = [c for c in C.CLIP_COLUMNS if c in df.columns]
    if not cols:
        return df
    q = exact_quantiles(df, {**{f"{c}__q1": (c, 0.25) for c in cols}, **{f"{c}__q3": (c, 0.75) for c in cols}}).first()
    clip = {}
    for c in cols:
        q1, q3 = q[f"{c}__q1"], q[f"{c}__q3"]
        x = F.col(c).cast("double")
        if q1 is None:
            clip[c] = x
            continue
        iqr = q3 - q1
        lo, hi = q1 - factor * iqr, q3 + factor * iqr
        clip[c] = F.when(x.isNull(), x).otherwise(F.greatest(F.least(x, lit_d(hi)), lit_d(lo)))
    return df.withColumns(clip)


def standardise_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.initcap(F.trim(F.col(c))) for c in C.TEXT_COLUMNS if c in df.columns})


def cast_types(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("tinyint") for c in C.TINYINT_COLUMNS if c in df.columns})


def clean(df: DataFrame) -> DataFrame:
    """``clean_data``: all steps in order. The deduped frame is checkpointed (reliable
    files in spark.checkpoint.dir) because each statistics job and the final plan read it."""
    d = dedupe(df).checkpoint(eager=True)
    nulls = _null_counts(d, d.columns)          # one job serves both imputations
    x = impute_mode(impute_median(d, nulls), nulls)
    return cast_types(standardise_text(iqr_clip(x)))
