"""Model-input preparation: impute + scale + one-hot, as columns or as a Spark ML pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, MinMaxScaler, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.functions.exprs import lit_d, present
from churnlake.functions.stats import broadcast_stats, exact_quantiles
from churnlake.operators.clean import column_mode

PREP_NUMERIC = ["CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "EstimatedSalary"]
PREP_CATEGORICAL = ["Geography", "Gender"]


def _levels(df: DataFrame, c: str) -> list[str]:
    """Sorted distinct levels of a categorical column. They come to the driver because each becomes an
    output column, so there may be at most ``config.MAX_LEVELS``; for more use ``prep_pipeline`` (sparse vectors)."""
    rows = df.select(F.col(c).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct().limit(C.MAX_LEVELS + 1).collect()
    if len(rows) > C.MAX_LEVELS:
        raise ValueError(f"{c} has more than {C.MAX_LEVELS} levels to make columns of; use prep_pipeline")
    return sorted((r["v"] for r in rows), key=lambda v: v.encode())


def prep_columns(df: DataFrame, numeric: Sequence[str] = PREP_NUMERIC, categorical: Sequence[str] = PREP_CATEGORICAL,
                 scaler: str = "standard", key: str = C.ID) -> DataFrame:
    """Median impute + standard (population sd) or min-max scale; most-frequent impute + one-hot.
    A constant column is only centred (scale 1); a column without any value stays null."""
    numeric, categorical = list(numeric), list(categorical)
    med = exact_quantiles(df, {c: (c, 0.5) for c in numeric}).first()
    fills = {c: present(df, c).cast("double") for c in numeric}
    fills |= {c: F.coalesce(fills[c], lit_d(med[c])) for c in numeric if med[c] is not None}
    for c in categorical:
        m = column_mode(df, c)
        fills[c] = F.coalesce(F.col(c).cast("string"), F.lit(m))
    imp = df.select(key, *[e.alias(c) for c, e in fills.items()])
    if scaler == "standard":
        stats = imp.agg(*[a for c in numeric for a in (F.avg(c).alias(f"__a_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
        scaled = [F.when(F.col(f"__s_{c}") == 0, F.col(c) - F.col(f"__a_{c}"))
                  .otherwise((F.col(c) - F.col(f"__a_{c}")) / F.col(f"__s_{c}")).alias(c) for c in numeric]
    else:
        stats = imp.agg(*[a for c in numeric for a in (F.min(c).alias(f"__a_{c}"), F.max(c).alias(f"__s_{c}"))])
        scaled = [F.when(F.col(f"__s_{c}") == F.col(f"__a_{c}"), F.col(c) - F.col(f"__a_{c}"))
                  .otherwise((F.col(c) - F.col(f"__a_{c}")) / (F.col(f"__s_{c}") - F.col(f"__a_{c}"))).alias(c)
                  for c in numeric]
    onehot = [(F.col(c) == F.lit(v)).cast("int").alias(f"{c}_{v}") for c in categorical for v in _levels(imp, c)]
    return broadcast_stats(imp, stats).select(key, *scaled, *onehot)


def prep_pipeline(numeric: Sequence[str] = PREP_NUMERIC, categorical: Sequence[str] = PREP_CATEGORICAL,
                  scaler: str = "standard", output: str = "features") -> Pipeline:
    """The same preprocessing as a Spark ML pipeline (Imputer median is approximate)."""
    numeric, categorical = list(numeric), list(categorical)
    imp_out = [f"{c}__imp" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=imp_out)]
    idx_out = [f"{c}__idx" for c in categorical]
    oh_out = [f"{c}__oh" for c in categorical]
    stages.append(StringIndexer(inputCols=categorical, outputCols=idx_out, stringOrderType="alphabetAsc",
                                handleInvalid="keep"))
    stages.append(OneHotEncoder(inputCols=idx_out, outputCols=oh_out, dropLast=True, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=imp_out, outputCol="__num"))
    if scaler == "standard":
        stages.append(StandardScaler(inputCol="__num", outputCol="__num_scaled", withMean=True, withStd=True))
    else:
        stages.append(MinMaxScaler(inputCol="__num", outputCol="__num_scaled"))
    stages.append(VectorAssembler(inputCols=["__num_scaled", *oh_out], outputCol=output))
    return Pipeline(stages=stages)


def ml_matrix(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """0/1 columns Geo_Germany, Geo_Spain, Gender_Male; the present ML features, nulls -> 0."""
    x = df.withColumns({
        "Geo_Germany": (F.col("Geography").cast("string") == "Germany").cast("int"),
        "Geo_Spain": (F.col("Geography").cast("string") == "Spain").cast("int"),
        "Gender_Male": (F.col("Gender").cast("string") == "Male").cast("int"),
    })
    feats = [c for c in C.ML_FEATURES if c in x.columns]
    out = x.select(*keep, *feats, C.TARGET)
    return out.fillna(0, subset=feats)
