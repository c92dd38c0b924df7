"""Scaling check: the sf0.1 customer base replicated r times (ids offset), main operators timed.

usage: python tools/scale_bench.py [replicas ...]   (default 1 10 100)
Prints one JSON line per replica count. Each operator result is executed into the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402


def main() -> None:
    reps = [int(x) for x in sys.argv[1:]] or [1, 10, 100]
    from churnlake.operators import eda as EDA
    from churnlake.operators import features as FE
    from churnlake.operators import kpi as K
    from churnlake.operators import quality as Q
    from churnlake.operators import rules as R
    from churnlake.operators.clean import clean
    from churnlake.plans import stages
    from churnlake.session import local_session, scratch_path
    from churnlake.sources.base import dirty_from_base

    spark = local_session(shuffle_partitions=16, app="churnlake-scale")
    base = stages.base(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"))
    for r in reps:
        path = scratch_path(spark, f"replica-{r}-{uuid.uuid4().hex[:6]}")
        rep = F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("__rep")
        (base.select("*", rep).withColumn("CustomerId", F.col("CustomerId") + F.col("__rep").cast("long") * F.lit(10_000_000))
         .drop("__rep").write.parquet(path))
        b = spark.read.parquet(path)
        n = b.count()
        ops = {
            "features": lambda: FE.engineer_features(b),
            "kpi_report": lambda: K.kpi_report(FE.engineer_features(b)),
            "validation_report": lambda: Q.validation_report(dirty_from_base(b)),
            "quality_summary": lambda: Q.quality_summary(b),
            "clean": lambda: clean(dirty_from_base(b)),
            "retention_summary": lambda: R.retention_summary(R.assign_actions(FE.engineer_features(b))),
            "balance_terciles": lambda: EDA.balance_tercile_churn(b),
            "age_box": lambda: EDA.box_by_class(b, "Age"),
        }
        times = {}
        for name, op in ops.items():
            t0 = time.perf_counter()
            op().write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 2)
        print(json.dumps({"replicas": r, "rows": n, "sec": times, "total": round(sum(times.values()), 2)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
