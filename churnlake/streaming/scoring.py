"""Structured Streaming: score arriving customer rows with frozen batch statistics.

The feature min/max values are fitted once on a batch table (like a model) and
applied as literals, so features, retention rules and the fixed-logit score are
stateless per-row projections: no watermark or state store is needed and the
same operator code runs on a streaming DataFrame. Output goes to any sink with
a checkpoint in the shared folder, so a restarted query resumes exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.operators import features as FE
from churnlake.operators import rules as R
from churnlake.sources.files import CUSTOMER_SCHEMA


@dataclass
class FeatureStats:
    """Min/max of the first-pass inputs and of the four re-normalised raw scores."""
    pass1: dict
    pass2: dict

    @classmethod
    def fit(cls, batch: DataFrame) -> "FeatureStats":
        p1 = FE.minmax_values(batch, FE.pass1_inputs())
        raw = _first_pass_with(batch, p1)
        p2 = FE.minmax_values(raw, {k: F.col(k) for k in FE.SECOND_PASS})
        return cls(p1, p2)

    def transform(self, df: DataFrame) -> DataFrame:
        raw = _first_pass_with(df, self.pass1)
        finals = {v: FE.norm_with(self.pass2, k, F.col(k)) for k, v in FE.SECOND_PASS.items()}
        cols = [finals[n].alias(n) if n in finals else F.col(n) for n in C.FEATURE_COLUMNS]
        return raw.select(*df.columns, *cols)


def _first_pass_with(df: DataFrame, stats: dict) -> DataFrame:
    return FE.first_pass(df, stats)


def score_stream(stream: DataFrame, stats: FeatureStats) -> DataFrame:
    """Features -> retention plan -> fixed-logit probability and tier, per arriving row."""
    feat = stats.transform(stream)
    planned = R.assign_actions(feat)
    return R.score_customers(planned)


def read_customer_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Files of customers as a stream; all that are there in one micro-batch unless a number is given."""
    reader = spark.readStream.schema(CUSTOMER_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def run_to_parquet(scored: DataFrame, out_path: str, checkpoint: str) -> None:
    """Drain everything available (availableNow) into Parquet, then stop."""
    q = (scored.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
