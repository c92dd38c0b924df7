"""Customer segmentation: z-scored behaviour features, KMeans, PCA, profiles and personas.

The scaled features are one aggregate (mean / population sd) + a projection.
All KMeans restarts, and all numbers of clusters, share their scans (``operators/kmeans``); PCA
is a Spark ML estimator.
Profiles are a group-by over clusters (k rows); persona matching is a
k x 12-row broadcast join; labels go back by a broadcast join on the cluster id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.functions.exprs import lit_d
from churnlake.functions.parallel import parallel_map
from churnlake.functions.tables import small_table
from churnlake.operators import kmeans as KM

Z = [f"z_{c}" for c in C.SEGMENT_FEATURES]


def require_features(df: DataFrame, feats: Sequence[str] = C.SEGMENT_FEATURES) -> None:
    missing = [f for f in feats if f not in df.columns]
    if missing:
        raise ValueError(f"Missing engineered features: {missing}. Run feature engineering first.")


def scale_features(df: DataFrame, feats: Sequence[str] = C.SEGMENT_FEATURES) -> DataFrame:
    """z-score with the population sd; nulls -> 0 first; a constant feature scores 0."""
    feats = list(feats)
    filled = [F.coalesce(F.col(c).cast("double"), lit_d(0.0)) for c in feats]
    st = df.agg(*[a for i, x in enumerate(filled) for a in (F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"))]).first()
    z = []
    for i, c in enumerate(feats):
        m, sd = st[f"m{i}"], st[f"s{i}"]
        if m is None or not sd:
            z.append(lit_d(0.0).alias(f"z_{c}"))
        else:
            z.append(((filled[i] - lit_d(m)) / lit_d(sd)).alias(f"z_{c}"))
    return df.select(*df.columns, *z)


def _vectors(scaled: DataFrame, zcols: Sequence[str] = Z) -> DataFrame:
    return VectorAssembler(inputCols=list(zcols), outputCol="__v").transform(scaled)


def _arrays(scaled: DataFrame, zcols: Sequence[str] = Z) -> DataFrame:
    return scaled.select(F.array(*[F.col(z).cast("double") for z in zcols]).alias("__x"))


def kmeans_best(scaled: DataFrame, k: int = C.N_CLUSTERS, restarts: int = C.KMEANS_RESTARTS, seed: int = C.SEED,
                max_iter: int = 300, zcols: Sequence[str] = Z):
    """Best (lowest within-cluster cost) of ``restarts`` seeded runs, all in the same scans.
    Returns (run, cost, centre order); a run's centres are in order of their coordinates,
    so labels are stable across runs."""
    run = KM.best(KM.fit(_arrays(scaled, zcols), "__x", [k], restarts, seed, max_iter)[k])
    return run, run.cost, list(range(len(run.centres)))


def assign_kmeans(scaled: DataFrame, model, order: Sequence[int], zcols: Sequence[str] = Z) -> DataFrame:
    centres = model.clusterCenters()
    return assign_nearest(scaled, [[float(v) for v in centres[i]] for i in order], zcols)


def assign_nearest(scaled: DataFrame, centres: Sequence[Sequence[float]], zcols: Sequence[str] = Z) -> DataFrame:
    """Nearest of given centres (squared Euclidean); on equal distance the lower cluster number.
    The k centres are literals in one projection: no join, no shuffle."""
    d = []
    for c in centres:
        terms = [(F.col(z) - lit_d(v)) * (F.col(z) - lit_d(v)) for z, v in zip(zcols, c)]
        s = terms[0]
        for t in terms[1:]:
            s = s + t
        d.append(s)
    x = scaled.withColumns({f"__d{i}": di for i, di in enumerate(d)})
    dcols = [F.col(f"__d{i}") for i in range(len(d))]
    best = F.least(*dcols) if len(dcols) > 1 else dcols[0]
    cl = None
    for i, di in enumerate(dcols):
        cl = F.when(di == best, F.lit(i)) if cl is None else cl.when(di == best, F.lit(i))
    return x.withColumn("Cluster", cl.cast("int")).drop(*[f"__d{i}" for i in range(len(d))])


def fixed_centres(scaled: DataFrame, ids: Sequence[int] = tuple(range(C.N_CLUSTERS)), zcols: Sequence[str] = Z):
    """Centres = the scaled feature rows of the given customer ids (bounded collect of k rows)."""
    rows = {r[C.ID]: [r[z] for z in zcols] for r in scaled.where(F.col(C.ID).isin(*ids)).select(C.ID, *zcols).collect()}
    return [rows[i] for i in ids]


def optimal_k(scaled: DataFrame, ks: Sequence[int] = C.OPTIMAL_K_RANGE, restarts: int = C.OPTIMAL_K_RESTARTS,
              seed: int = C.SEED, max_iter: int = 300) -> DataFrame:
    """(k, inertia, silhouette) rows. The runs of all k share their scans; silhouette is Spark's
    squared-Euclidean evaluator (linear cost)."""
    scaled = scaled.select(*Z).persist(StorageLevel.MEMORY_AND_DISK)

    def one_k(k):
        run = KM.best(runs[k])
        return k, run.cost, silhouette(assign_kmeans(scaled, run, range(len(run.centres))))

    try:
        runs = KM.fit(_arrays(scaled), "__x", list(ks), restarts, seed, max_iter)
        rows = parallel_map(one_k, ks)
    finally:
        scaled.unpersist()
    return scaled.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def silhouette(clustered: DataFrame, zcols: Sequence[str] = Z) -> float:
    ev = ClusteringEvaluator(featuresCol="__v", predictionCol="Cluster", distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(_vectors(clustered, zcols)))


def pca2(scaled: DataFrame, zcols: Sequence[str] = Z) -> DataFrame:
    """Two principal components of the (already centred) z-scores as PCA_1, PCA_2.
    Sign fixed so that each component's largest-magnitude loading is positive."""
    v = _vectors(scaled, zcols)
    model = PCA(k=2, inputCol="__v", outputCol="__pc").fit(v)
    pc = model.pc.toArray()
    signs = []
    for j in range(2):
        col = pc[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    arr = vector_to_array(F.col("__pc"))
    out = model.transform(v).withColumn("PCA_1", arr[0] * lit_d(signs[0])).withColumn("PCA_2", arr[1] * lit_d(signs[1]))
    return out.drop("__v", "__pc")


def profile(clustered: DataFrame, feats: Sequence[str] | None = None) -> DataFrame:
    feats = list(feats or (C.SEGMENT_FEATURES + C.PROFILE_EXTRA))
    present = [f for f in feats if f in clustered.columns]
    return clustered.groupBy("Cluster").agg(
        *[F.round(F.avg(f), 3).alias(f) for f in present],
        F.count(F.lit(1)).alias("CustomerCount"),
        F.round(F.avg("Exited"), 3).alias("ChurnRate"),
    )


def persona_rules(spark) -> DataFrame:
    order = {}
    for p, *_ in C.PERSONA_RULES:
        order.setdefault(p, len(order))
    rows = [(order[p], p, f, float(lo), float(hi)) for p, f, lo, hi in C.PERSONA_RULES]
    return small_table(spark, rows, "persona_order int, persona string, feature string, lo double, hi double")


def persona_map(prof: DataFrame) -> DataFrame:
    """Cluster -> persona with the most rule hits on the rounded means; the first persona wins ties.
    A rule on a feature absent from the profile never counts."""
    rules = persona_rules(prof.sparkSession)
    feats = sorted({f for _p, f, *_ in C.PERSONA_RULES} & set(prof.columns))
    long = prof.unpivot(["Cluster"], feats, "feature", "value")
    hits = long.join(F.broadcast(rules), "feature").where(F.col("value").between(F.col("lo"), F.col("hi"))) \
        .groupBy("Cluster", "persona").agg(F.count(F.lit(1)).alias("hits"))
    order = {}
    for p, *_ in C.PERSONA_RULES:
        order.setdefault(p, len(order))
    personas = F.array(*[F.struct(F.lit(i).alias("persona_order"), F.lit(p).alias("persona")) for p, i in order.items()])
    cand = prof.select("Cluster", F.inline(personas))    # every cluster x the 6 personas (literal list, no join)
    scored = cand.join(hits, ["Cluster", "persona"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    w = Window.partitionBy("Cluster").orderBy(F.col("hits").desc(), F.col("persona_order").asc())
    return scored.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).select("Cluster", "persona", "hits")


def label_personas(clustered: DataFrame, prof: DataFrame | None = None) -> DataFrame:
    prof = prof if prof is not None else profile(clustered)
    m = persona_map(prof).select("Cluster", F.col("persona").alias("Persona"))
    return clustered.join(F.broadcast(m), "Cluster", "left")


def persona_counts(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("Persona").agg(F.count(F.lit(1)).alias("customers")).orderBy(F.desc("customers"), "Persona")


def segment_customers(df: DataFrame, k: int = C.N_CLUSTERS, restarts: int = C.KMEANS_RESTARTS,
                      max_iter: int = 300, fitted=None) -> DataFrame:
    """``segment_customers``: check features, KMeans (or ``fitted``, what ``kmeans_best`` returned for
    these rows), PCA, profile, personas."""
    require_features(df)
    scaled = scale_features(df).checkpoint(eager=True)          # read by every pass, PCA and assignment
    model, _cost, order = fitted or kmeans_best(scaled, k=k, restarts=restarts, max_iter=max_iter)
    clustered = pca2(assign_kmeans(scaled, model, order)).checkpoint(eager=True)  # profile + join back
    out = label_personas(clustered)
    return out.drop(*Z)


def segment_fixed(df: DataFrame) -> DataFrame:
    """Deterministic variant: nearest of the centres given by customers 0..k-1."""
    scaled = scale_features(df).checkpoint(eager=True)
    clustered = assign_nearest(scaled, fixed_centres(scaled)).checkpoint(eager=True)
    return label_personas(clustered).drop(*Z)

