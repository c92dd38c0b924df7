"""§2.2 validation and data-quality queries (on the dirty customer base)."""

from __future__ import annotations

from churnlake import config as C
from churnlake.operators import quality as Q
from churnlake.plans import stages
from churnlake.plans.catalog import register
from churnlake.plans.oracle_base import BASE_SQL, DIRTY_SQL, with_ctes
from churnlake.plans.oracle_common import D, values_cte
from churnlake.plans.oracle_features import feat_sql

DIRTY_CTES = (BASE_SQL, DIRTY_SQL)
DIRTY_TYPES = [("CustomerId", "bigint"), ("Surname", "string"), ("CreditScore", "int"), ("Geography", "string"),
               ("Gender", "string"), ("Age", "int"), ("Tenure", "int"), ("Balance", "double"),
               ("NumOfProducts", "int"), ("HasCrCard", "int"), ("IsActiveMember", "int"),
               ("EstimatedSalary", "double"), ("Exited", "int")]
COLS = [c for c, _ in DIRTY_TYPES]
NUMERIC = [c for c, t in DIRTY_TYPES if t != "string"]
DROPPED = ["Surname", "EstimatedSalary"]

NULL_STR = "CAST(NULL AS VARCHAR)"


def q(c: str) -> str:
    return f'"{c}"'


def _nulls_sql(src: str = "dirty") -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in COLS)
    return (f"(SELECT 'nulls' AS \"check\", \"column\", CASE WHEN n_bad / n > {D(C.NULL_THRESHOLD)} THEN 'issue' ELSE 'warning' END AS severity, "
            f"CAST(n_bad AS BIGINT) AS n_bad, round(n_bad / n, 6) AS pct, {NULL_STR} AS detail "
            f"FROM (UNPIVOT (SELECT count(*) AS n, {counts} FROM {src}) ON {', '.join(COLS)} INTO NAME \"column\" VALUE n_bad) WHERE n_bad > 0)")


def _dups_sql(src: str = "dirty") -> str:
    return (f"(SELECT 'duplicates' AS \"check\", {NULL_STR} AS \"column\", "
            f"CASE WHEN n_bad / n > {D(C.DUPLICATE_THRESHOLD)} THEN 'issue' ELSE 'warning' END AS severity, "
            f"CAST(n_bad AS BIGINT) AS n_bad, round(n_bad / n, 6) AS pct, {NULL_STR} AS detail FROM "
            f"(SELECT sum(c) AS n, sum(c - 1) AS n_bad FROM (SELECT count(*) AS c FROM {src} GROUP BY {', '.join(COLS)})) "
            f"WHERE n_bad > 0)")


def _ranges_sql(src: str = "dirty") -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS {c}" for c, (lo, hi) in C.RANGES.items())
    return (f"(SELECT 'ranges' AS \"check\", \"column\", 'warning' AS severity, CAST(n_bad AS BIGINT) AS n_bad, "
            f"round(n_bad / n, 6) AS pct, {NULL_STR} AS detail FROM "
            f"(UNPIVOT (SELECT count(*) AS n, {counts} FROM {src}) ON {', '.join(C.RANGES)} INTO NAME \"column\" VALUE n_bad) WHERE n_bad > 0)")


def _offenders_sql(check: str, severity: str, cond_of, cols: list[str], src: str = "dirty") -> str:
    items = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {src} WHERE {cond_of(c)}" for c in cols)
    return (f"(SELECT '{check}' AS \"check\", \"column\", '{severity}' AS severity, count(*) AS n_bad, "
            f"CAST(NULL AS DOUBLE) AS pct, value AS detail FROM ({items}) GROUP BY \"column\", value)")


def _binary_sql(src: str = "dirty") -> str:
    return _offenders_sql("binary", "issue", lambda c: f"{c} IS NOT NULL AND {c} NOT IN (0, 1)", C.BINARY_COLUMNS, src)


def _categorical_sql(src: str = "dirty") -> str:
    def cond(c):
        dom = ", ".join(f"'{v}'" for v in C.CATEGORICAL_DOMAINS[c])
        return f"{c} IS NOT NULL AND CAST({c} AS VARCHAR) NOT IN ({dom})"
    return _offenders_sql("categorical", "warning", cond, list(C.CATEGORICAL_DOMAINS), src)


_REQ_SQL = with_ctes(*DIRTY_CTES, values_cte("missing", ["c"], [(c,) for c in sorted(DROPPED)]),
                     body=f"SELECT 'required_columns' AS \"check\", c AS \"column\", 'issue' AS severity, "
                          f"CAST(NULL AS BIGINT) AS n_bad, CAST(NULL AS DOUBLE) AS pct, 'missing column' AS detail FROM missing")


@register("val_required_columns", _REQ_SQL)
def val_required_columns(spark, sf_dir):
    """Contract check on an extract that lacks two columns."""
    return Q.required_columns(stages.dirty(spark, sf_dir).drop(*DROPPED))


@register("val_nulls", with_ctes(*DIRTY_CTES, body=f"SELECT * FROM {_nulls_sql()}"))
def val_nulls(spark, sf_dir):
    return Q.null_checks(stages.dirty(spark, sf_dir))


@register("val_duplicates", with_ctes(*DIRTY_CTES, body=f"SELECT * FROM {_dups_sql()}"))
def val_duplicates(spark, sf_dir):
    return Q.duplicate_check(stages.dirty(spark, sf_dir))


@register("val_ranges", with_ctes(*DIRTY_CTES, body=f"SELECT * FROM {_ranges_sql()}"))
def val_ranges(spark, sf_dir):
    return Q.range_checks(stages.dirty(spark, sf_dir))


@register("val_binary", with_ctes(*DIRTY_CTES, body=f"SELECT * FROM {_binary_sql()}"))
def val_binary(spark, sf_dir):
    return Q.binary_checks(stages.dirty(spark, sf_dir))


@register("val_categorical", with_ctes(*DIRTY_CTES, body=f"SELECT * FROM {_categorical_sql()}"))
def val_categorical(spark, sf_dir):
    return Q.categorical_checks(stages.dirty(spark, sf_dir))


_REPORT_SQL = with_ctes(
    *DIRTY_CTES,
    f"f AS ({_nulls_sql()} UNION ALL {_dups_sql()} UNION ALL {_ranges_sql()} UNION ALL {_binary_sql()} UNION ALL {_categorical_sql()})",
    body=f"SELECT f.*, (SELECT coalesce(bool_and(severity <> 'issue'), TRUE) FROM f) AS passed, "
         f"(SELECT count(*) FROM dirty) AS n_rows, {len(COLS)} AS n_columns FROM f",
)


@register("val_report", _REPORT_SQL)
def val_report(spark, sf_dir):
    return Q.validation_report(stages.dirty(spark, sf_dir))


def _summary_sql(src: str = "dirty") -> str:
    items = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {('CAST(' + c + ' AS DOUBLE)') if c in NUMERIC else 'CAST(NULL AS DOUBLE)'} AS num, "
        f"CAST({c} AS VARCHAR) AS value FROM {src}" for c in COLS)
    nulls = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in COLS)
    return with_ctes(
        *DIRTY_CTES,
        values_cte("dt", ['"column"', "dtype"], DIRTY_TYPES),
        f"nl AS (UNPIVOT (SELECT count(*) AS n, {nulls} FROM {src}) ON {', '.join(COLS)} INTO NAME \"column\" VALUE null_count)",
        f"ds AS (SELECT DISTINCT * FROM ({items}) WHERE value IS NOT NULL)",
        "uq AS (SELECT \"column\", count(*) AS unique_values FROM ds GROUP BY \"column\")",
        "sm AS (SELECT \"column\", string_agg(value, ', ' ORDER BY rn) AS sample_values FROM "
        "(SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY num, value) AS rn FROM ds) WHERE rn <= 5 GROUP BY \"column\")",
        body=f"SELECT dt.\"column\", dtype, CAST(null_count AS BIGINT) AS null_count, "
             f"round(null_count * {D(100.0)} / n, 2) AS null_pct, CAST(coalesce(unique_values, 0) AS BIGINT) AS unique_values, "
             f"coalesce(sample_values, '') AS sample_values "
             f"FROM dt JOIN nl USING (\"column\") LEFT JOIN uq USING (\"column\") LEFT JOIN sm USING (\"column\")",
    )


@register("quality_summary", _summary_sql())
def quality_summary(spark, sf_dir):
    return Q.quality_summary(stages.dirty(spark, sf_dir))


OUTLIER_COLS = ["CreditScore", "Age", "Tenure", "Balance", "EstimatedSalary"]


def outlier_sql(src_ctes, src: str, cols: list[str]) -> str:
    lng = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM {src}" for c in cols)
    return with_ctes(
        *src_ctes,
        f"lng AS ({lng})",
        "st AS (SELECT \"column\", count(x) AS n, avg(x) AS mean, stddev_pop(x) AS sdp, stddev_samp(x) AS sd, min(x) AS mn, "
        "max(x) AS mx, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM lng GROUP BY \"column\")",
        "m AS (SELECT \"column\", avg(power(x - mean, 3)) AS m3, avg(power(x - mean, 2)) AS m2, "
        "count(*) FILTER (WHERE abs(CASE WHEN sdp = 0 THEN NULL ELSE (x - mean) / sdp END) > 3) AS z, "
        f"count(*) FILTER (WHERE x < q1 - {D(1.5)} * (q3 - q1) OR x > q3 + {D(1.5)} * (q3 - q1)) AS iqr "
        "FROM lng JOIN st USING (\"column\") WHERE x IS NOT NULL GROUP BY \"column\")",
        body=f"SELECT \"column\", CAST(z AS BIGINT) AS z_outliers, round(z * {D(100.0)} / n, 2) AS z_outlier_pct, "
             f"CAST(iqr AS BIGINT) AS iqr_outliers, round(iqr * {D(100.0)} / n, 2) AS iqr_outlier_pct, "
             "round(mean, 2) AS mean, round(sd, 2) AS std, mn AS min, mx AS max, "
             "CASE WHEN n > 2 THEN CASE WHEN m2 = 0 THEN 0.0 ELSE round(m3 / power(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2), 3) END END AS skewness FROM st JOIN m USING (\"column\")",
    )


@register("outlier_report", outlier_sql(DIRTY_CTES, "dirty", OUTLIER_COLS))
def outlier_report(spark, sf_dir):
    return Q.outlier_report(stages.dirty(spark, sf_dir), OUTLIER_COLS)


DESCRIBE_COLS = ["Age", "Balance", "CreditScore", "Tenure"]


def describe_sql(src_ctes, src: str, cols: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 2) AS mean, "
        f"round(stddev_samp({c}), 2) AS std, round(CAST(min({c}) AS DOUBLE), 2) AS min, "
        f"round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50, "
        f"round(quantile_cont({c}, 0.75), 2) AS p75, round(CAST(max({c}) AS DOUBLE), 2) AS max FROM {src}" for c in cols)
    return with_ctes(*src_ctes, body=parts)


@register("describe_numeric", describe_sql((BASE_SQL, feat_sql("base", "feat")), "feat", DESCRIBE_COLS))
def describe_numeric(spark, sf_dir):
    return Q.describe_numeric(stages.features(spark, sf_dir), DESCRIBE_COLS)
