"""SMOTE oversampling of the minority class, distributed.

Neighbours: the exact k nearest minority rows of every minority row
(``operators/knn.py``: equal vectors collapsed, a tree of cells with the boxes of their
members, a probe round and a verification round over bounded co-groups).

Synthetic points: the number per minority row is floor(new / m) plus one for the
rows whose hash is below the exact (new mod m)-th smallest hash, so the total is
exact. Each point is x + u * (neighbour - x) with the neighbour and u drawn from
seeded hashes of (id, draw).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.functions.stats import exact_order_stats
from churnlake.operators.knn import exact_knn_with_duplicates


def _u01(*cols) -> F.Column:
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30)))


def smote(train: DataFrame, id_col: str = C.ID, label_col: str = C.TARGET, features_col: str = "features",
          ratio: float = C.SMOTE_RATIO, k: int = C.SMOTE_NEIGHBOURS, seed: int = C.SEED) -> DataFrame:
    """Return synthetic minority rows (id, label, features, is_synthetic=1) to union with ``train``.

    A synthetic row has no id (null): an id worked out from its base row could overflow."""
    counts = {r[label_col]: r["n"] for r in train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = train.sparkSession
    empty = spark.createDataFrame([], train.select(id_col, label_col, features_col).schema).withColumn("is_synthetic", F.lit(1))
    if len(counts) < 2:
        return empty
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    n_min, n_maj = counts[minority], counts[majority]
    n_new = int(ratio * n_maj) - n_min
    if n_new <= 0 or n_min < 2:
        return empty
    m = train.where(F.col(label_col) == minority).select(F.col(id_col).cast("long").alias("id"),
                                                         vector_to_array(F.col(features_col)).alias("f"))
    nb = exact_knn_with_duplicates(m, k, seed).where(F.size("nb") > 0)
    base, extra = divmod(n_new, n_min)
    h = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 52))  # exact in a double
    x = m.join(nb, "id").withColumn("__h", h).checkpoint(eager=True)  # read twice; cut the neighbour lineage
    if extra:
        thr = exact_order_stats(x, "__h", {(): extra - 1}).first()["value"]
        cnt = F.lit(base) + (F.col("__h").cast("double") <= F.lit(thr)).cast("int")
    else:
        cnt = F.lit(base)
    draws = x.withColumn("__n", cnt).where(F.col("__n") > 0) \
        .select("id", "f", "nb", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__s"))
    j = F.pmod(F.xxhash64("id", "__s", F.lit(seed + 1)), F.size("nb")) + 1
    u = _u01(F.col("id"), F.col("__s"), F.lit(seed + 2))
    picked = draws.withColumn("__nbv", F.element_at("nb", j.cast("int"))).withColumn("__u", u)
    synth = F.zip_with("f", "__nbv", lambda a, b: a + F.col("__u") * (b - a))
    return picked.select(
        F.lit(None).cast(train.schema[id_col].dataType).alias(id_col),
        F.lit(minority).cast(train.schema[label_col].dataType).alias(label_col),
        array_to_vector(synth).alias(features_col),
        F.lit(1).alias("is_synthetic"),
    )
