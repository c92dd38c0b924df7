"""The twelve behavioural features.

Every normalised input needs the global min and max of its column, and four
outputs are normalised again, so the whole stage is exactly two aggregate
jobs (partial aggregation per task, one row out) followed by one projection.
The one-row results are inlined as literals, so the feature projection is a
single whole-stage-codegen span with no join at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.functions.exprs import flag, lit_d, minmax_norm, right_closed_bin

COLS = ["IsActiveMember", "NumOfProducts", "HasCrCard", "Tenure", "Balance", "EstimatedSalary", "CreditScore"]


def _cols():
    return tuple(F.col(c) for c in COLS)


def pass1_inputs() -> dict[str, Column]:
    """Inputs whose min/max the first pass needs."""
    A, P, CC, T, B, S, K = _cols()
    return {
        "T": T, "P": P, "B": B, "K": K, "S": S,
        "INV_K": lit_d(1.0) / (K + 1),
        "DEPTH": P * (T + 1),
        "BSR": B / (S + 1),
    }


def minmax_values(df: DataFrame, inputs: dict[str, Column]) -> dict[str, tuple]:
    """One aggregate job -> {name: (min, max)} (a single row on the driver)."""
    aggs = []
    for k, e in inputs.items():
        aggs += [F.min(e).cast("double").alias(f"mn_{k}"), F.max(e).cast("double").alias(f"mx_{k}")]
    row = df.agg(*aggs).first()
    return {k: (row[f"mn_{k}"], row[f"mx_{k}"]) for k in inputs}


def _lit_or_null(v) -> Column:
    return lit_d(v) if v is not None else F.lit(None).cast("double")


def norm_with(stats: dict[str, tuple], name: str, x: Column) -> Column:
    lo, hi = stats[name]
    return minmax_norm(x, _lit_or_null(lo), _lit_or_null(hi))


def normalise(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feat_minmax_norm``: N(x) for any column list, one aggregate job."""
    st = minmax_values(df, {c: F.col(c) for c in columns})
    return df.select(*df.columns, *[norm_with(st, c, F.col(c)).alias(f"{c}_norm") for c in columns])


def first_pass(df: DataFrame, st: dict | None = None) -> DataFrame:
    """Pass-1 features and the four raw scores; ``st`` = frozen min/max (else one aggregate job)."""
    A, P, CC, T, B, S, K = _cols()
    st = st if st is not None else minmax_values(df, pass1_inputs())
    x = df

    def norm_of(name: str, e: Column) -> Column:
        return norm_with(st, name, e)
    nP, nT, nB, nK, nS = (norm_of(k, F.col(c)) for k, c in
                          [("P", "NumOfProducts"), ("T", "Tenure"), ("B", "Balance"), ("K", "CreditScore"), ("S", "EstimatedSalary")])
    eng = C.ENGAGEMENT_WEIGHTS
    rel = C.RELATIONSHIP_WEIGHTS
    loy = C.LOYALTY_WEIGHTS
    fin = C.FINANCIAL_COMMITMENT_WEIGHTS
    stab = C.STABILITY_WEIGHTS
    points = (
        flag(A == 0) * 2 + flag(F.col("Age") > 50) + flag(P >= 3) + flag(B == 0) + flag(T < 2)
    )
    return x.select(
        *df.columns,
        (lit_d(eng["IsActiveMember"]) * A + lit_d(eng["NumOfProducts"]) * nP
         + lit_d(eng["HasCrCard"]) * CC + lit_d(eng["Tenure"]) * nT).alias("EngagementScore"),
        (lit_d(rel["Tenure"]) * nT + lit_d(rel["NumOfProducts"]) * nP
         + lit_d(rel["Balance"]) * nB + lit_d(rel["CreditScore"]) * nK).alias("RelationshipStrengthIndex"),
        (nP * (F.lit(1) + lit_d(C.UTILIZATION_CARD_BOOST) * CC)
         * (lit_d(C.UTILIZATION_ACTIVE_FLOOR) + lit_d(C.UTILIZATION_ACTIVE_WEIGHT) * A)).alias("__PUS"),
        (lit_d(loy["Tenure"]) * nT + lit_d(loy["IsActiveMember"]) * A
         + lit_d(loy["NumOfProducts"]) * nP).alias("LoyaltyScore"),
        (nB * (F.lit(1) - A) * norm_of("INV_K", lit_d(1.0) / (K + 1))).alias("__PRS"),
        (lit_d(fin["Balance"]) * nB + lit_d(fin["EstimatedSalary"]) * nS
         + lit_d(fin["NumOfProducts"]) * nP).alias("FinancialCommitmentIndex"),
        (A * (lit_d(C.INTENSITY_PRODUCT_WEIGHT) * nP + lit_d(C.INTENSITY_CARD_WEIGHT) * CC)
         * (F.lit(1) + lit_d(C.INTENSITY_TENURE_BOOST) * nT)).alias("__AIS"),
        (norm_of("DEPTH", P * (T + 1))
         * F.when(CC == 1, lit_d(1.0)).otherwise(lit_d(C.DEPTH_NO_CARD_FACTOR))).alias("__PDI"),
        (lit_d(stab["CreditScore"]) * nK + lit_d(stab["Tenure"]) * nT
         + lit_d(stab["Balance"]) * nB + lit_d(stab["EstimatedSalary"]) * nS).alias("StabilityScore"),
        F.least(points, F.lit(C.RISK_CATEGORY_CAP)).cast("int").alias("ChurnRiskCategory"),
        norm_of("BSR", B / (S + 1)).alias("BalanceSalaryRatio"),
        right_closed_bin(F.col("Age"), C.AGE_SEGMENT_EDGES, [0, 1, 2, 3]).cast("int").alias("AgeSegment"),
    )


SECOND_PASS = {"__PUS": "ProductUtilizationScore", "__PRS": "PremiumRiskScore",
               "__AIS": "ActivityIntensityScore", "__PDI": "ProductDepthIndex"}


def engineer_features(df: DataFrame) -> DataFrame:
    """``feat_all``: input columns + the 12 features, in the declared order."""
    x = first_pass(df)
    st2 = minmax_values(x, {k: F.col(k) for k in SECOND_PASS})
    y = x
    finals = {v: norm_with(st2, k, F.col(k)) for k, v in SECOND_PASS.items()}
    cols = []
    for name in C.FEATURE_COLUMNS:
        cols.append(finals[name].alias(name) if name in finals else F.col(name))
    return y.select(*df.columns, *cols)
