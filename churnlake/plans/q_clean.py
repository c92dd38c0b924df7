"""§2.3 cleaning and preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.operators import clean as CL
from churnlake.operators import prep as PR
from churnlake.plans import stages
from churnlake.plans.catalog import register
from churnlake.plans.oracle_base import BASE_SQL, DIRTY_SQL, with_ctes
from churnlake.plans.oracle_common import D
from churnlake.plans.oracle_features import feat_sql

DIRTY_CTES = (BASE_SQL, DIRTY_SQL)
COLS = C.BASE_COLUMNS


def initcap_sql(x: str) -> str:
    return f"(upper(left(trim({x}), 1)) || lower(substr(trim({x}), 2)))"


DEDUP = "dd AS (SELECT DISTINCT * FROM dirty)"
MED = ("md AS (SELECT quantile_cont(CreditScore, 0.5) AS m_CreditScore, quantile_cont(Balance, 0.5) AS m_Balance FROM dd)")
MODE = ("mo AS (SELECT Geography AS m_Geography FROM dd WHERE Geography IS NOT NULL GROUP BY Geography "
        "ORDER BY count(*) DESC, Geography LIMIT 1)")
IMPUTED = ("im AS (SELECT dd.* REPLACE (coalesce(CAST(CreditScore AS DOUBLE), m_CreditScore) AS CreditScore, "
           "coalesce(Balance, m_Balance) AS Balance, coalesce(Geography, m_Geography) AS Geography) "
           "FROM dd CROSS JOIN md CROSS JOIN mo)")
CLIP_Q = "fq AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in C.CLIP_COLUMNS) + " FROM im)"


def _clip(c: str) -> str:
    lo = f"(q1_{c} - {D(3.0)} * (q3_{c} - q1_{c}))"
    hi = f"(q3_{c} + {D(3.0)} * (q3_{c} - q1_{c}))"
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest(least(CAST({c} AS DOUBLE), {hi}), {lo}) END AS {c}"


CLIPPED = "cl AS (SELECT im.* REPLACE (" + ", ".join(_clip(c) for c in C.CLIP_COLUMNS) + ") FROM im CROSS JOIN fq)"
TEXT = (f"tx AS (SELECT cl.* REPLACE ({initcap_sql('Geography')} AS Geography, {initcap_sql('Gender')} AS Gender) FROM cl)")
CAST = ("cleaned AS (SELECT tx.* REPLACE (" + ", ".join(f"CAST({c} AS TINYINT) AS {c}" for c in C.TINYINT_COLUMNS)
        + ") FROM tx)")
CLEAN_CTES = (*DIRTY_CTES, DEDUP, MED, MODE, IMPUTED, CLIP_Q, CLIPPED, TEXT, CAST)


def deduped(spark, sf_dir):
    """Deduplicated dirty rows, checkpointed: every following statistics job reads them."""
    return CL.dedupe(stages.dirty(spark, sf_dir)).checkpoint(eager=True)


@register("clean_dedupe", with_ctes(*DIRTY_CTES, DEDUP, body="SELECT * FROM dd"))
def clean_dedupe(spark, sf_dir):
    return CL.dedupe(stages.dirty(spark, sf_dir))


@register("clean_impute_median", with_ctes(
    *DIRTY_CTES, DEDUP, MED,
    body="SELECT dd.* REPLACE (coalesce(CAST(CreditScore AS DOUBLE), m_CreditScore) AS CreditScore, "
         "coalesce(Balance, m_Balance) AS Balance) FROM dd CROSS JOIN md"))
def clean_impute_median(spark, sf_dir):
    return CL.impute_median(deduped(spark, sf_dir))


@register("clean_impute_mode", with_ctes(
    *DIRTY_CTES, DEDUP, MODE, body="SELECT dd.* REPLACE (coalesce(Geography, m_Geography) AS Geography) FROM dd CROSS JOIN mo"))
def clean_impute_mode(spark, sf_dir):
    return CL.impute_mode(deduped(spark, sf_dir))


@register("clean_iqr_clip", with_ctes(*DIRTY_CTES, DEDUP, MED, MODE, IMPUTED, CLIP_Q, CLIPPED, body="SELECT * FROM cl"))
def clean_iqr_clip(spark, sf_dir):
    d = deduped(spark, sf_dir)
    return CL.iqr_clip(CL.impute_mode(CL.impute_median(d)))


@register("clean_standardise_text", with_ctes(
    *DIRTY_CTES, body=f"SELECT dirty.* REPLACE ({initcap_sql('Geography')} AS Geography, {initcap_sql('Gender')} AS Gender) FROM dirty"))
def clean_standardise_text(spark, sf_dir):
    return CL.standardise_text(stages.dirty(spark, sf_dir))


@register("clean_cast_types", with_ctes(
    *DIRTY_CTES, body="SELECT dirty.* REPLACE (" + ", ".join(f"CAST({c} AS TINYINT) AS {c}" for c in C.TINYINT_COLUMNS) + ") FROM dirty"))
def clean_cast_types(spark, sf_dir):
    return CL.cast_types(stages.dirty(spark, sf_dir))


@register("clean_full", with_ctes(*CLEAN_CTES, body="SELECT * FROM cleaned"))
def clean_full(spark, sf_dir):
    return CL.clean(stages.dirty(spark, sf_dir))


# --------------------------------------------------------------------------
# preprocessing (column form of the impute / scale / one-hot pipeline)
# --------------------------------------------------------------------------
PREP_SRC = (f"ps AS (SELECT dirty.* REPLACE ({initcap_sql('Geography')} AS Geography, "
            f"{initcap_sql('Gender')} AS Gender) FROM dirty)")
NUM = PR.PREP_NUMERIC
CAT_LEVELS = {"Geography": ["France", "Germany", "Spain"], "Gender": ["Female", "Male", "Unknown"]}


def _prep_sql(kind: str) -> str:
    med = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in NUM)
    imp = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in NUM)
    modes = ", ".join(
        f"(SELECT {c} FROM ps WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS f_{c}"
        for c in CAT_LEVELS)
    if kind == "standard":
        st = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in NUM)
        scaled = ", ".join(f"round(CASE WHEN s_{c} = 0 THEN {c} - a_{c} ELSE ({c} - a_{c}) / s_{c} END, 9) AS {c}" for c in NUM)
    else:
        st = ", ".join(f"min({c}) AS a_{c}, max({c}) AS s_{c}" for c in NUM)
        scaled = ", ".join(f"CASE WHEN s_{c} = a_{c} THEN {c} - a_{c} ELSE ({c} - a_{c}) / (s_{c} - a_{c}) END AS {c}" for c in NUM)
    onehot = ", ".join(
        f"CAST(coalesce({c}, f_{c}) = '{v}' AS INTEGER) AS {c}_{v}" for c, levels in CAT_LEVELS.items() for v in levels)
    return with_ctes(
        *DIRTY_CTES, PREP_SRC,
        f"pm AS (SELECT {med}, {modes} FROM ps)",
        f"pi AS (SELECT CustomerId, {imp}, Geography, Gender, pm.* FROM ps CROSS JOIN pm)",
        f"pst AS (SELECT {st} FROM pi)",
        body=f"SELECT CustomerId, {scaled}, {onehot} FROM pi CROSS JOIN pst",
    )


@register("prep_standard", _prep_sql("standard"))
def prep_standard(spark, sf_dir):
    src = CL.standardise_text(stages.dirty(spark, sf_dir))
    out = PR.prep_columns(src, scaler="standard")
    # scaled by an aggregate sd: round away the last-bit differences of summation order
    return out.withColumns({c: F.round(F.col(c), 9) for c in NUM})


@register("prep_minmax", _prep_sql("minmax"))
def prep_minmax(spark, sf_dir):
    src = CL.standardise_text(stages.dirty(spark, sf_dir))
    return PR.prep_columns(src, scaler="minmax")


_ML_SQL = with_ctes(
    BASE_SQL, feat_sql("base", "feat"),
    body="SELECT CustomerId, " + ", ".join(
        f"coalesce({c}, 0) AS {c}" for c in C.ML_FEATURES if not c.startswith(("Geo_", "Gender_")))
    + ", CAST(coalesce(CAST(Geography AS VARCHAR) = 'Germany', FALSE) AS INTEGER) AS Geo_Germany"
    + ", CAST(coalesce(CAST(Geography AS VARCHAR) = 'Spain', FALSE) AS INTEGER) AS Geo_Spain"
    + ", CAST(coalesce(CAST(Gender AS VARCHAR) = 'Male', FALSE) AS INTEGER) AS Gender_Male, Exited FROM feat")


@register("prep_onehot_ml", _ML_SQL)
def prep_onehot_ml(spark, sf_dir):
    return PR.ml_matrix(stages.features(spark, sf_dir), keep=["CustomerId"]).select(
        "CustomerId", *[c for c in C.ML_FEATURES if not c.startswith(("Geo_", "Gender_"))],
        "Geo_Germany", "Geo_Spain", "Gender_Male", "Exited")

