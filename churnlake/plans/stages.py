"""The derived stages every query starts from.

``base`` and ``features`` are materialised once as Parquet tables in the shared
checkpoint folder (``spark.checkpoint.dir``) and read back: later queries get
column pruning and predicate pushdown on the stage files, the lineage is cut,
and a lost executor re-reads files instead of recomputing the order
aggregation. The table name carries a fingerprint of the input files (path,
size, modification time) and of the code that defines the stages, so a changed
input or a changed definition is never served from a stale stage.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import DataFrame, SparkSession

from churnlake.operators.features import engineer_features
from churnlake.session import ensure_checkpoint_dir
from churnlake.sources.base import customer_base, dirty_from_base
from churnlake.sources.files import fingerprint, load_or_compute

INPUTS = ["customer", "nation", "orders"]


def _code_fingerprint() -> str:
    """Hash of the source that defines the stages: a code change never reuses an old stage."""
    import churnlake.config
    import churnlake.functions.exprs
    import churnlake.operators.features
    import churnlake.operators.segment
    import churnlake.sources.base

    h = hashlib.sha1()
    for mod in (churnlake.config, churnlake.functions.exprs, churnlake.operators.features, churnlake.operators.segment, churnlake.sources.base):
        with open(inspect.getsourcefile(mod), "rb") as fh:
            h.update(fh.read())
    return h.hexdigest()[:12]


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    root = sf_dir.rstrip("/")
    listing = fingerprint(spark, [f"{root}/{t}.parquet" for t in INPUTS])
    return hashlib.sha1(f"{root}|{_code_fingerprint()}|{listing}".encode()).hexdigest()[:16]


def _stage_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    ns = spark.conf.get("spark.churnlake.stageNamespace", "") or "shared"
    return f"{root}/stages/{ns}/{_fingerprint(spark, sf_dir)}/{name}"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_or_compute(spark, _stage_path(spark, sf_dir, "customer_base"), lambda: customer_base(spark, sf_dir))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_from_base(base(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_or_compute(spark, _stage_path(spark, sf_dir, "features"), lambda: engineer_features(base(spark, sf_dir)))


def key(spark: SparkSession, sf_dir: str) -> str:
    """Identifies the input and the code that stages depend on, for caches kept by a session."""
    return _fingerprint(spark, sf_dir)


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with scaled features and the cluster of the nearest fixed centre."""
    from churnlake.operators import segment as SG

    def compute():
        scaled = SG.scale_features(features(spark, sf_dir))
        return SG.assign_nearest(scaled, SG.fixed_centres(scaled))

    return load_or_compute(spark, _stage_path(spark, sf_dir, "assigned"), compute)
