"""Retention rule engine and the fixed-logit churn score.

Rules are evaluated as one ordered ``when`` chain that yields a rule id; the
texts come from a broadcast join to the fixed rule and action tables (9 and 10
rows). Everything is a per-row projection: no shuffle, no Python, and the same
functions work on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake import config as C
from churnlake.functions.exprs import lit_d
from churnlake.functions.tables import small_table

D = C.RULE_ABSENT_DEFAULTS


def _col_or(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def rule_id(df: DataFrame) -> Column:
    """Id of the first matching rule (1..8), 0 for the default plan."""
    bal = _col_or(df, "Balance", D["Balance"])
    act = _col_or(df, "IsActiveMember", D["IsActiveMember"])
    high_balance = bal > C.RULE_HIGH_BALANCE
    inactive = act == 0
    geo = _col_or(df, "Geography", D["Geography"]).cast("string")
    r = [
        high_balance & inactive,
        (_col_or(df, "NumOfProducts", D["NumOfProducts_rule2"]) >= C.RULE_MULTI_PRODUCTS)
        & (_col_or(df, "ChurnRiskCategory", D["ChurnRiskCategory"]) >= C.RULE_RISK_CATEGORY),
        (F.lower(geo) == "germany") & inactive,
        (_col_or(df, "NumOfProducts", D["NumOfProducts_rule4"]) == 1)
        & (_col_or(df, "Tenure", D["Tenure"]) < C.RULE_EARLY_TENURE),
        (_col_or(df, "Age", D["Age_rule5"]) >= C.RULE_SENIOR_AGE) & high_balance,
        (_col_or(df, "HasCrCard", D["HasCrCard"]) == 1) & inactive,
        _col_or(df, "EngagementScore", D["EngagementScore"]) < C.RULE_LOW_ENGAGEMENT,
        _col_or(df, "Age", D["Age_rule8"]) < C.RULE_YOUNG_AGE,
    ]
    out = F.when(r[0], F.lit(1))
    for i, cond in enumerate(r[1:], start=2):
        out = out.when(cond, F.lit(i))
    return out.otherwise(F.lit(0))


def rules_table(spark) -> DataFrame:
    icons = dict(C.URGENCY_ICONS)
    rows = [(rid, urg, icons[urg], prim, sec, why) for rid, urg, prim, sec, why in C.RETENTION_RULES]
    schema = T.StructType([
        T.StructField("__rule_id", T.IntegerType()), T.StructField("RetentionUrgency", T.StringType()),
        T.StructField("RetentionUrgencyIcon", T.StringType()), T.StructField("PrimaryAction", T.StringType()),
        T.StructField("SecondaryAction", T.StringType()), T.StructField("RetentionRationale", T.StringType()),
    ])
    return small_table(spark, rows, schema)


def actions_table(spark) -> DataFrame:
    schema = "action_key string, action string, channel string, timeline string, cost_tier string, description string"
    return small_table(spark, list(C.RETENTION_ACTIONS), schema)


def assign_actions(df: DataFrame) -> DataFrame:
    """``score_retention_actions``: input + urgency, icon, primary, secondary, rationale."""
    x = df.withColumn("__rule_id", rule_id(df))
    return x.join(F.broadcast(rules_table(df.sparkSession)), "__rule_id").drop("__rule_id")


def plan_detail(scored: DataFrame) -> DataFrame:
    """Both actions of every customer's plan with channel, timeline, cost and description."""
    acts = actions_table(scored.sparkSession)
    prim = acts.select(*[F.col(c).alias(f"primary_{c}") for c in acts.columns])
    sec = acts.select(*[F.col(c).alias(f"secondary_{c}") for c in acts.columns])
    out = (
        scored.join(F.broadcast(prim), scored.PrimaryAction == prim.primary_action_key, "left")
        .join(F.broadcast(sec), scored.SecondaryAction == sec.secondary_action_key, "left")
    )
    return out.drop("primary_action_key", "secondary_action_key")


def retention_summary(scored: DataFrame) -> DataFrame:
    u = F.col("RetentionUrgency")
    return scored.agg(
        F.count(F.lit(1)).alias("total_customers"),
        *[F.count_if(u == t).alias(f"{t.lower()}_count") for t in C.URGENCY_ORDER],
    )


def action_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("PrimaryAction").agg(F.count(F.lit(1)).alias("customers")).orderBy(F.desc("customers"), "PrimaryAction")


def urgency_distribution(scored: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(u) for u in C.URGENCY_ORDER]), F.col("RetentionUrgency")).cast("int")
    return scored.groupBy("RetentionUrgency").agg(F.count(F.lit(1)).alias("customers")) \
        .withColumn("urgency_order", order)


# --------------------------------------------------------------------------
# Fixed-logit score
# --------------------------------------------------------------------------

def _logit_inputs() -> dict[str, Column]:
    A, CC, P, T_, B, S, K, AGE = (F.col(c) for c in
                                  ["IsActiveMember", "HasCrCard", "NumOfProducts", "Tenure", "Balance",
                                   "EstimatedSalary", "CreditScore", "Age"])
    ger = (F.col("Geography") == "Germany").cast("int")
    spa = (F.col("Geography") == "Spain").cast("int")
    loyalty = lit_d(0.40) * (T_ / lit_d(10.0)) + lit_d(0.35) * A + lit_d(0.25) * (P / lit_d(4.0))
    fci = (lit_d(0.50) * (F.least(B, lit_d(C.LOGIT_BALANCE_CAP)) / lit_d(C.LOGIT_BALANCE_CAP))
           + lit_d(0.30) * (S / lit_d(C.LOGIT_SALARY_SCALE)) + lit_d(0.20) * (P / lit_d(4.0)))
    return {"A": A, "C": CC, "P": P, "T": T_, "B": B, "K": K, "AGE": AGE, "ger": ger, "spa": spa,
            "loyalty": loyalty, "fci": fci}


def logit_expr() -> Column:
    v = _logit_inputs()
    return (
        lit_d(C.LOGIT_INTERCEPT) + lit_d(C.LOGIT_AGE) * (v["AGE"] - C.LOGIT_AGE_CENTER)
        + lit_d(C.LOGIT_CREDIT) * (F.lit(300) - v["K"]) / lit_d(10.0)
        - lit_d(-C.LOGIT_TENURE) * v["T"] + lit_d(C.LOGIT_BALANCE) * v["B"]
        + lit_d(C.LOGIT_GERMANY) * v["ger"] + lit_d(C.LOGIT_SPAIN) * v["spa"]
        - lit_d(-C.LOGIT_ACTIVE) * v["A"] + lit_d(C.LOGIT_PRODUCTS3) * (v["P"] >= 3).cast("int")
        - lit_d(-C.LOGIT_CARD) * v["C"]
        - lit_d(-C.LOGIT_LOYALTY) * v["loyalty"] + lit_d(C.LOGIT_FCI_INACTIVE) * v["fci"] * (F.lit(1) - v["A"])
    )


def churn_probability() -> Column:
    return lit_d(1.0) / (lit_d(1.0) + F.exp(-logit_expr()))


def risk_tier(prob: Column) -> tuple[Column, Column]:
    tier = None
    action = None
    for lo, name, text in C.RISK_TIERS:
        tier = F.when(prob >= lo, F.lit(name)) if tier is None else tier.when(prob >= lo, F.lit(name))
        action = F.when(prob >= lo, F.lit(text)) if action is None else action.when(prob >= lo, F.lit(text))
    return tier.otherwise(F.lit(C.RISK_TIER_LOW[0])), action.otherwise(F.lit(C.RISK_TIER_LOW[1]))


def score_customers(df: DataFrame) -> DataFrame:
    """Probability, tier and tier action for every row."""
    x = df.withColumn("churn_prob", churn_probability())
    tier, action = risk_tier(F.col("churn_prob"))
    return x.withColumn("risk_tier", tier).withColumn("risk_action", action)


def driver_effects() -> list[tuple[str, Column]]:
    v = _logit_inputs()
    raw = [
        lit_d(C.LOGIT_AGE) * (v["AGE"] - C.LOGIT_AGE_CENTER),
        lit_d(C.LOGIT_CREDIT) * (F.lit(300) - v["K"]) / lit_d(10.0),
        lit_d(C.LOGIT_TENURE) * v["T"],
        lit_d(C.LOGIT_BALANCE) * v["B"],
        lit_d(C.LOGIT_GERMANY) * v["ger"] + lit_d(C.LOGIT_SPAIN) * v["spa"],
        lit_d(C.LOGIT_ACTIVE) * v["A"],
        lit_d(C.LOGIT_PRODUCTS3) * (v["P"] >= 3).cast("int"),
        lit_d(C.LOGIT_LOYALTY) * v["loyalty"],
    ]
    return [(name, F.round(e, 3)) for name, e in zip(C.DRIVER_NAMES, raw)]


def top_drivers(df: DataFrame, key: str = "CustomerId", top: int = C.TOP_DRIVERS) -> DataFrame:
    """Per row the ``top`` effects by absolute size; ties keep the declared order."""
    items = [
        F.struct((-F.abs(e)).alias("neg_abs"), F.lit(i).alias("pos"), F.lit(name).alias("driver"), e.alias("effect"))
        for i, (name, e) in enumerate(driver_effects())
    ]
    ranked = F.slice(F.sort_array(F.array(*items)), 1, top)
    return (
        df.select(key, F.posexplode(ranked).alias("rank0", "d"))
        .select(key, (F.col("rank0") + 1).alias("rank"), F.col("d.driver").alias("driver"), F.col("d.effect").alias("effect"))
    )
