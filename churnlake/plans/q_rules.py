"""§2.11 retention rules and the fixed-logit score."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake import config as C
from churnlake.operators import rules as R
from churnlake.plans import stages
from churnlake.plans.catalog import register
from churnlake.plans.oracle_base import BASE_SQL, with_ctes
from churnlake.plans.oracle_common import D, values_cte
from churnlake.plans.oracle_features import feat_sql

FEAT_CTES = (BASE_SQL, feat_sql("base", "feat"))

RULE_ID_SQL = f"""CASE WHEN Balance > {C.RULE_HIGH_BALANCE} AND IsActiveMember = 0 THEN 1
  WHEN NumOfProducts >= 3 AND ChurnRiskCategory >= 3 THEN 2
  WHEN lower(CAST(Geography AS VARCHAR)) = 'germany' AND IsActiveMember = 0 THEN 3
  WHEN NumOfProducts = 1 AND Tenure < 3 THEN 4
  WHEN Age >= 50 AND Balance > {C.RULE_HIGH_BALANCE} THEN 5
  WHEN HasCrCard = 1 AND IsActiveMember = 0 THEN 6
  WHEN EngagementScore < {D(0.35)} THEN 7
  WHEN Age < 30 THEN 8 ELSE 0 END"""


def rules_cte() -> str:
    icons = dict(C.URGENCY_ICONS)
    rows = [(rid, u, icons[u], p, s, why) for rid, u, p, s, why in C.RETENTION_RULES]
    return values_cte("rdim", ["rule_id", "RetentionUrgency", "RetentionUrgencyIcon", "PrimaryAction",
                               "SecondaryAction", "RetentionRationale"], rows)


def actions_cte() -> str:
    return values_cte("adim", ["action_key", "action", "channel", "timeline", "cost_tier", "description"],
                      list(C.RETENTION_ACTIONS))


SCORED_CTES = (*FEAT_CTES, rules_cte(),
               f"scored AS (SELECT feat.*, rdim.* EXCLUDE (rule_id) FROM feat JOIN rdim ON ({RULE_ID_SQL}) = rdim.rule_id)")
RET_COLS = "CustomerId, RetentionUrgency, RetentionUrgencyIcon, PrimaryAction, SecondaryAction, RetentionRationale"


def scored(spark, sf_dir):
    return R.assign_actions(stages.features(spark, sf_dir))


@register("ret_assign_actions", with_ctes(*SCORED_CTES, body=f"SELECT {RET_COLS} FROM scored"))
def ret_assign_actions(spark, sf_dir):
    return scored(spark, sf_dir).select(*[c.strip() for c in RET_COLS.split(",")])


_detail_cols = ["action", "channel", "timeline", "cost_tier", "description"]
_DETAIL_SQL = with_ctes(
    *SCORED_CTES, actions_cte(),
    body="SELECT CustomerId, RetentionUrgency, PrimaryAction, SecondaryAction, "
         + ", ".join(f"p.{c} AS primary_{c}" for c in _detail_cols) + ", "
         + ", ".join(f"s.{c} AS secondary_{c}" for c in _detail_cols)
         + " FROM scored LEFT JOIN adim p ON scored.PrimaryAction = p.action_key"
           " LEFT JOIN adim s ON scored.SecondaryAction = s.action_key",
)


@register("ret_plan_detail", _DETAIL_SQL)
def ret_plan_detail(spark, sf_dir):
    d = R.plan_detail(scored(spark, sf_dir))
    return d.select("CustomerId", "RetentionUrgency", "PrimaryAction", "SecondaryAction",
                    *[f"primary_{c}" for c in _detail_cols], *[f"secondary_{c}" for c in _detail_cols])


_SUMMARY_SQL = with_ctes(
    *SCORED_CTES,
    body="SELECT count(*) AS total_customers, "
         + ", ".join(f"count(*) FILTER (WHERE RetentionUrgency = '{u}') AS {u.lower()}_count" for u in C.URGENCY_ORDER)
         + " FROM scored",
)


@register("ret_summary", _SUMMARY_SQL)
def ret_summary(spark, sf_dir):
    return R.retention_summary(scored(spark, sf_dir))


@register("ret_action_distribution", with_ctes(
    *SCORED_CTES, body="SELECT PrimaryAction, count(*) AS customers FROM scored GROUP BY PrimaryAction"))
def ret_action_distribution(spark, sf_dir):
    return R.action_distribution(scored(spark, sf_dir))


_URG_ORDER_SQL = "CASE RetentionUrgency " + " ".join(
    f"WHEN '{u}' THEN {i}" for i, u in enumerate(C.URGENCY_ORDER, start=1)) + " END"


@register("ret_urgency_distribution", with_ctes(
    *SCORED_CTES,
    body=f"SELECT RetentionUrgency, count(*) AS customers, CAST({_URG_ORDER_SQL} AS INTEGER) AS urgency_order "
         "FROM scored GROUP BY RetentionUrgency"))
def ret_urgency_distribution(spark, sf_dir):
    return R.urgency_distribution(scored(spark, sf_dir))


# --------------------------------------------------------------------------
# fixed-logit score
# --------------------------------------------------------------------------
LOY_SQL = f"({D(0.4)} * (Tenure / {D(10.0)}) + {D(0.35)} * IsActiveMember + {D(0.25)} * (NumOfProducts / {D(4.0)}))"
FCI_SQL = (f"({D(0.5)} * (least(Balance, {D(200000.0)}) / {D(200000.0)}) + {D(0.3)} * (EstimatedSalary / {D(200000.0)})"
           f" + {D(0.2)} * (NumOfProducts / {D(4.0)}))")
GER = "CAST(Geography = 'Germany' AS INTEGER)"
SPA = "CAST(Geography = 'Spain' AS INTEGER)"
LOGIT_SQL = (
    f"({D(-3.8)} + {D(0.048)} * (Age - 38) + {D(0.006)} * (300 - CreditScore) / {D(10.0)}"
    f" - {D(0.18)} * Tenure + {D(0.000003)} * Balance + {D(0.95)} * {GER} + {D(0.15)} * {SPA}"
    f" - {D(0.85)} * IsActiveMember + {D(1.2)} * CAST(NumOfProducts >= 3 AS INTEGER) - {D(0.25)} * HasCrCard"
    f" - {D(1.8)} * {LOY_SQL} + {D(0.8)} * {FCI_SQL} * (1 - IsActiveMember))"
)
PROB_SQL = f"({D(1.0)} / ({D(1.0)} + exp(-{LOGIT_SQL})))"


def _tier_sql(p: str, what: int) -> str:
    parts = " ".join(f"WHEN {p} >= {D(lo)} THEN '{(name, text)[what]}'" for lo, name, text in C.RISK_TIERS)
    return f"CASE {parts} ELSE '{C.RISK_TIER_LOW[what]}' END"


SCORE_CTES = (BASE_SQL, f"sc AS (SELECT *, {PROB_SQL} AS churn_prob FROM base)")


@register("score_logit", with_ctes(*SCORE_CTES, body="SELECT CustomerId, round(churn_prob, 6) AS churn_prob FROM sc"))
def score_logit(spark, sf_dir):
    s = R.score_customers(stages.base(spark, sf_dir))
    return s.select("CustomerId", F.round("churn_prob", 6).alias("churn_prob"))


@register("score_risk_tier", with_ctes(
    *SCORE_CTES,
    body=f"SELECT CustomerId, {_tier_sql('churn_prob', 0)} AS risk_tier, {_tier_sql('churn_prob', 1)} AS risk_action FROM sc"))
def score_risk_tier(spark, sf_dir):
    return R.score_customers(stages.base(spark, sf_dir)).select("CustomerId", "risk_tier", "risk_action")


@register("score_tier_distribution", with_ctes(
    *SCORE_CTES,
    f"t AS (SELECT *, {_tier_sql('churn_prob', 0)} AS risk_tier FROM sc)",
    body="SELECT risk_tier, count(*) AS customers, round(count(*) / (SELECT count(*) FROM sc), 6) AS share, "
         "round(avg(churn_prob), 6) AS mean_prob FROM t GROUP BY risk_tier"))
def score_tier_distribution(spark, sf_dir):
    s = R.score_customers(stages.base(spark, sf_dir))
    g = s.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("customers"), F.avg("churn_prob").alias("__m"))
    total = g.agg(F.sum("customers").alias("__n"))  # from the grouped counts, no second scoring
    return g.crossJoin(F.broadcast(total)).select(
        "risk_tier", "customers", F.round(F.col("customers") / F.col("__n"), 6).alias("share"),
        F.round("__m", 6).alias("mean_prob"))


_EFFECTS_SQL = [
    f"{D(0.048)} * (Age - 38)",
    f"{D(0.006)} * (300 - CreditScore) / {D(10.0)}",
    f"{D(-0.18)} * Tenure",
    f"{D(0.000003)} * Balance",
    f"{D(0.95)} * {GER} + {D(0.15)} * {SPA}",
    f"{D(-0.85)} * IsActiveMember",
    f"{D(1.2)} * CAST(NumOfProducts >= 3 AS INTEGER)",
    f"{D(-1.8)} * {LOY_SQL}",
]
_eff_rows = " UNION ALL ".join(
    f"SELECT CustomerId, {i} AS pos, '{name}' AS driver, round({e}, 3) AS effect FROM base"
    for i, (name, e) in enumerate(zip(C.DRIVER_NAMES, _EFFECTS_SQL)))


@register("score_top_drivers", with_ctes(
    BASE_SQL, f"e AS ({_eff_rows})",
    f"r AS (SELECT *, row_number() OVER (PARTITION BY CustomerId ORDER BY abs(effect) DESC, pos) AS rank FROM e)",
    body=f"SELECT CustomerId, CAST(rank AS INTEGER) AS rank, driver, effect FROM r WHERE rank <= {C.TOP_DRIVERS}"))
def score_top_drivers(spark, sf_dir):
    return R.top_drivers(stages.base(spark, sf_dir))
