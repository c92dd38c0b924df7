"""§2.1 sources and sinks as round trips through the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.operators import clean as CL
from churnlake.plans import stages
from churnlake.plans.catalog import register
from churnlake.plans.oracle_base import BASE_SQL, with_ctes
from churnlake.plans.oracle_features import feat_sql
from churnlake.plans.q_clean import CLEAN_CTES
from churnlake.plans.q_segment import SEG_CTES
from churnlake.operators import segment as SG
from churnlake.session import scratch_path
from churnlake.sources import files as IO

FEAT = (BASE_SQL, feat_sql("base", "feat"))


@register("src_csv_typed", with_ctes(BASE_SQL, body="SELECT * FROM base"))
def src_csv_typed(spark, sf_dir):
    path = scratch_path(spark, "raw-csv")
    IO.write_csv(stages.base(spark, sf_dir), path)
    return IO.read_customers_csv(spark, path)


@register("src_parquet", with_ctes(*FEAT, body="SELECT * FROM feat"))
def src_parquet(spark, sf_dir):
    path = scratch_path(spark, "features")
    IO.write_parquet(stages.features(spark, sf_dir), path)
    return IO.read_parquet(spark, path)


@register("sink_parquet", with_ctes(*CLEAN_CTES, body="SELECT * FROM cleaned"))
def sink_parquet(spark, sf_dir):
    path = scratch_path(spark, "clean")
    IO.write_parquet(CL.clean(stages.dirty(spark, sf_dir)), path)
    return IO.read_parquet(spark, path)


@register("sink_csv", with_ctes(BASE_SQL, body=f"SELECT {', '.join(C.EXPLORER_COLUMNS)} FROM base WHERE Exited = 1"))
def sink_csv(spark, sf_dir):
    path = scratch_path(spark, "filtered-csv")
    out = stages.base(spark, sf_dir).where(F.col("Exited") == 1).select(*C.EXPLORER_COLUMNS)
    IO.write_csv(out, path)
    return IO.read_csv(spark, path, out.schema)


@register("stage_load_or_compute", with_ctes(*SEG_CTES, body="SELECT CustomerId, Cluster, Persona FROM segmented"))
def stage_load_or_compute(spark, sf_dir):
    """First call writes a feature stage (no personas); the second call loads it and,
    because Persona is missing, segments it (deterministic fixed-centre path)."""
    path = scratch_path(spark, "stage")
    IO.load_or_compute(spark, path, lambda: stages.features(spark, sf_dir))

    def must_exist():
        raise RuntimeError("stage should exist")

    seg = IO.load_or_compute(spark, path, must_exist,
                             ensure=lambda df: df if "Persona" in df.columns else SG.segment_fixed(df))
    return seg.select("CustomerId", "Cluster", "Persona")
