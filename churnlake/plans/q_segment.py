"""§2.8 segmentation queries (+ the persona EDA queries that need segments).

The deterministic path (nearest of the centres given by customers 0..5) has
DuckDB oracles; the KMeans / PCA / silhouette queries are rows-only checks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.operators import segment as SG
from churnlake.operators.eda import churn_rate_by
from churnlake.plans import stages
from churnlake.plans.catalog import register
from churnlake.plans.oracle_base import BASE_SQL, with_ctes
from churnlake.plans.oracle_common import D, values_cte
from churnlake.plans.oracle_features import feat_sql

FEATS = C.SEGMENT_FEATURES

_SST = "sst AS (SELECT " + ", ".join(
    f"avg(coalesce(CAST({f} AS DOUBLE), {D(0.0)})) AS m_{f}, stddev_pop(coalesce(CAST({f} AS DOUBLE), {D(0.0)})) AS s_{f}"
    for f in FEATS) + " FROM feat)"
_SCALED = "scaled AS (SELECT feat.*, " + ", ".join(
    f"CASE WHEN s_{f} = 0 THEN {D(0.0)} ELSE (coalesce(CAST({f} AS DOUBLE), {D(0.0)}) - m_{f}) / s_{f} END AS z_{f}"
    for f in FEATS) + " FROM feat CROSS JOIN sst)"
_DIST = " + ".join(f"(s.z_{f} - c.z_{f}) * (s.z_{f} - c.z_{f})" for f in FEATS)
_ASSIGN = (f"cen AS (SELECT CustomerId AS cid, {', '.join('z_' + f for f in FEATS)} FROM scaled WHERE CustomerId < {C.N_CLUSTERS})",
           f"dd AS (SELECT s.CustomerId, CAST(c.cid AS INTEGER) AS cluster, {_DIST} AS dist FROM scaled s CROSS JOIN cen c)",
           "asg AS (SELECT CustomerId, cluster AS Cluster FROM (SELECT *, row_number() OVER (PARTITION BY CustomerId ORDER BY dist, cluster) AS rn FROM dd) WHERE rn = 1)",
           "clustered AS (SELECT scaled.*, asg.Cluster FROM scaled JOIN asg USING (CustomerId))")
PROFILE_COLS = [c for c in C.SEGMENT_FEATURES + C.PROFILE_EXTRA]
_PROFILE = ("prof AS (SELECT Cluster, " + ", ".join(f"round(avg({c}), 3) AS {c}" for c in PROFILE_COLS)
            + ", count(*) AS CustomerCount, round(avg(Exited), 3) AS ChurnRate FROM clustered GROUP BY Cluster)")
_order = {}
for _p, *_r in C.PERSONA_RULES:
    _order.setdefault(_p, len(_order))
_RULES = values_cte("prules", ["persona_order", "persona", "feature", "lo", "hi"],
                    [(_order[p], p, f, float(lo), float(hi)) for p, f, lo, hi in C.PERSONA_RULES])
_PFEATS = sorted({f for _p, f, *_ in C.PERSONA_RULES} & set(PROFILE_COLS))
_PERSONA = (
    _RULES,
    f"plong AS (UNPIVOT (SELECT Cluster, {', '.join(_PFEATS)} FROM prof) ON {', '.join(_PFEATS)} INTO NAME feature VALUE value)",
    "phits AS (SELECT Cluster, persona, count(*) AS hits FROM plong JOIN prules USING (feature) WHERE value BETWEEN lo AND hi GROUP BY ALL)",
    "pcand AS (SELECT Cluster, persona_order, persona FROM prof CROSS JOIN (SELECT DISTINCT persona_order, persona FROM prules))",
    "pmap AS (SELECT Cluster, persona AS Persona FROM (SELECT c.*, coalesce(h.hits, 0) AS hits, row_number() OVER "
    "(PARTITION BY c.Cluster ORDER BY coalesce(h.hits, 0) DESC, c.persona_order) AS rn FROM pcand c LEFT JOIN phits h USING (Cluster, persona)) WHERE rn = 1)",
    "segmented AS (SELECT clustered.*, pmap.Persona FROM clustered LEFT JOIN pmap USING (Cluster))",
)
SEG_CTES = (BASE_SQL, feat_sql("base", "feat"), _SST, _SCALED, *_ASSIGN, _PROFILE, *_PERSONA)


def _scaled(spark, sf_dir):
    return SG.scale_features(stages.features(spark, sf_dir))


def _fixed(spark, sf_dir):
    return stages.assigned(spark, sf_dir)


def segmented_fixed(spark, sf_dir):
    return SG.label_personas(_fixed(spark, sf_dir))


@register("seg_scale_features", with_ctes(*SEG_CTES[:4], body=f"SELECT CustomerId, {', '.join('round(z_' + f + ', 6) AS z_' + f for f in FEATS)} FROM scaled"))
def seg_scale_features(spark, sf_dir):
    return _scaled(spark, sf_dir).select("CustomerId", *[F.round(z, 6).alias(z) for z in SG.Z])


@register("seg_assign_fixed", with_ctes(*SEG_CTES[:8], body="SELECT CustomerId, Cluster FROM clustered"))
def seg_assign_fixed(spark, sf_dir):
    return _fixed(spark, sf_dir).select("CustomerId", "Cluster")


@register("seg_profile", with_ctes(*SEG_CTES[:9], body="SELECT * FROM prof"))
def seg_profile(spark, sf_dir):
    return SG.profile(_fixed(spark, sf_dir))


@register("seg_persona_label", with_ctes(*SEG_CTES, body="SELECT CustomerId, Cluster, Persona FROM segmented"))
def seg_persona_label(spark, sf_dir):
    return segmented_fixed(spark, sf_dir).select("CustomerId", "Cluster", "Persona")


@register("seg_persona_counts", with_ctes(*SEG_CTES, body="SELECT Persona, count(*) AS customers FROM segmented GROUP BY Persona"))
def seg_persona_counts(spark, sf_dir):
    return SG.persona_counts(segmented_fixed(spark, sf_dir))


@register("eda_persona_churn", with_ctes(*SEG_CTES, body="SELECT Persona, count(*) AS customers, round(avg(Exited), 6) AS churn_rate FROM segmented GROUP BY Persona"))
def eda_persona_churn(spark, sf_dir):
    return churn_rate_by(segmented_fixed(spark, sf_dir), "Persona").orderBy(F.desc("churn_rate"), "Persona")


@register("eda_persona_profile", with_ctes(
    *SEG_CTES, body="SELECT Persona, count(*) AS customers, round(avg(Exited), 6) AS churn_rate, round(avg(Balance), 6) AS avg_balance, "
                    "round(avg(EngagementScore), 6) AS avg_engagement, round(avg(LoyaltyScore), 6) AS avg_loyalty FROM segmented GROUP BY Persona"))
def eda_persona_profile(spark, sf_dir):
    s = segmented_fixed(spark, sf_dir)
    return s.groupBy("Persona").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.avg("Exited"), 6).alias("churn_rate"),
        F.round(F.avg("Balance"), 6).alias("avg_balance"), F.round(F.avg("EngagementScore"), 6).alias("avg_engagement"),
        F.round(F.avg("LoyaltyScore"), 6).alias("avg_loyalty")).orderBy(F.desc("churn_rate"), "Persona")


# ---------------------------------------------------------------- rows-only ----
_FITS: dict = {}


def _kmeans(spark, sf_dir):
    """The fit of this input, made once per session for the queries that read it (centres only)."""
    key = (spark.sparkContext.applicationId, sf_dir, stages.key(spark, sf_dir))
    if key not in _FITS:
        _FITS.clear()
        _FITS[key] = SG.kmeans_best(_scaled(spark, sf_dir))
    return _FITS[key]


@register("seg_kmeans")
def seg_kmeans(spark, sf_dir):
    model, _cost, order = _kmeans(spark, sf_dir)
    return SG.assign_kmeans(_scaled(spark, sf_dir), model, order).select("CustomerId", "Cluster")


@register("seg_optimal_k")
def seg_optimal_k(spark, sf_dir):
    return SG.optimal_k(_scaled(spark, sf_dir))


@register("seg_silhouette")
def seg_silhouette(spark, sf_dir):
    model, cost, order = _kmeans(spark, sf_dir)
    sil = SG.silhouette(SG.assign_kmeans(_scaled(spark, sf_dir), model, order))
    return spark.createDataFrame([(C.N_CLUSTERS, float(cost), sil)], "k int, inertia double, silhouette double")


@register("seg_pca2")
def seg_pca2(spark, sf_dir):
    return SG.pca2(_scaled(spark, sf_dir)).select("CustomerId", "PCA_1", "PCA_2")


@register("seg_full")
def seg_full(spark, sf_dir):
    out = SG.segment_customers(stages.features(spark, sf_dir), fitted=_kmeans(spark, sf_dir))
    return out.select("CustomerId", "Cluster", "PCA_1", "PCA_2", "Persona")
