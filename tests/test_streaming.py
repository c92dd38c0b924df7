"""Streaming scoring: equals the batch plan, and a restart from the checkpoint adds nothing twice."""

import tempfile

from churnlake.operators import rules as R
from churnlake.plans import stages
from churnlake.sources import files as IO
from churnlake.streaming import scoring as ST
from tests.conftest import SF_SMALL


def test_stream_equals_batch_and_restarts_exactly_once(spark):
    root = tempfile.mkdtemp(prefix="churnlake-stream-")
    base = stages.base(spark, SF_SMALL)
    src, out, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    IO.write_parquet(base.repartition(3), src)
    stats = ST.FeatureStats.fit(IO.read_parquet(spark, src))
    ST.run_to_parquet(ST.score_stream(ST.read_customer_stream(spark, src), stats), out, ckpt)
    first = IO.read_parquet(spark, out).count()
    # restart on the same checkpoint: every file was already committed, nothing is written again
    ST.run_to_parquet(ST.score_stream(ST.read_customer_stream(spark, src), stats), out, ckpt)
    assert IO.read_parquet(spark, out).count() == first == base.count()
    streamed = {r["CustomerId"]: (r["RetentionUrgency"], round(r["churn_prob"], 12))
                for r in IO.read_parquet(spark, out).collect()}
    batch = R.score_customers(R.assign_actions(stages.features(spark, SF_SMALL)))
    for r in batch.collect():
        assert streamed[r["CustomerId"]] == (r["RetentionUrgency"], round(r["churn_prob"], 12))
