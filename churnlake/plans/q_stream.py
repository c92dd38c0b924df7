"""Streaming form of the retention scoring (stateless, frozen feature statistics)."""

from __future__ import annotations

from churnlake.plans import stages
from churnlake.plans.catalog import register
from churnlake.plans.oracle_base import with_ctes
from churnlake.plans.q_rules import RET_COLS, SCORED_CTES
from churnlake.session import scratch_path
from churnlake.sources import files as IO
from churnlake.streaming import scoring as ST


@register("stream_retention_actions", with_ctes(*SCORED_CTES, body=f"SELECT {RET_COLS} FROM scored"))
def stream_retention_actions(spark, sf_dir):
    """Customers arrive as Parquet files; each micro-batch is scored with the batch statistics."""
    base = stages.base(spark, sf_dir)
    src = scratch_path(spark, "stream-in")
    IO.write_parquet(base.repartition(4), src)
    stats = ST.FeatureStats.fit(IO.read_parquet(spark, src))
    scored = ST.score_stream(ST.read_customer_stream(spark, src), stats)
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    ST.run_to_parquet(scored, out, ckpt)
    return IO.read_parquet(spark, out).select(*[c.strip() for c in RET_COLS.split(",")])
