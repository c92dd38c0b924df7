"""Business constants and tunables in one place.

Everything under "FIXED VALUES" must equal the behaviour being reproduced
(weights, thresholds, rule texts, dimension tables); it is stated here once,
in natural order, and every operator reads it from here.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Columns
# ---------------------------------------------------------------------------
ID = "CustomerId"
TARGET = "Exited"

BASE_COLUMNS = [
    "CustomerId", "Surname", "CreditScore", "Geography", "Gender", "Age",
    "Tenure", "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember",
    "EstimatedSalary", "Exited",
]

# ===========================================================================
# FIXED VALUES (must match the reproduced behaviour exactly)
# ===========================================================================

# --- data contract --------------------------------------------------------
REQUIRED_COLUMNS = list(BASE_COLUMNS)
RANGES = {
    "CreditScore": (300, 850),
    "Age": (18, 100),
    "Tenure": (0, 10),
    "NumOfProducts": (1, 4),
    "Balance": (0, 1_000_000),
    "EstimatedSalary": (0, 500_000),
}
BINARY_COLUMNS = ["HasCrCard", "IsActiveMember", "Exited"]
CATEGORICAL_DOMAINS = {
    "Geography": ["France", "Germany", "Spain"],
    "Gender": ["Male", "Female"],
}
NULL_THRESHOLD = 0.05        # share of nulls above which a column is an issue
DUPLICATE_THRESHOLD = 0.01   # share of duplicate rows above which it is an issue

# --- cleaning -------------------------------------------------------------
CLIP_COLUMNS = ["CreditScore", "Age", "Balance", "EstimatedSalary"]
CLIP_IQR_FACTOR = 3.0
TEXT_COLUMNS = ["Geography", "Gender"]
TINYINT_COLUMNS = ["HasCrCard", "IsActiveMember", "Exited", "NumOfProducts", "Tenure"]
OUTLIER_Z = 3.0
OUTLIER_IQR_FACTOR = 1.5

# --- engineered feature names, in output order -----------------------------
FEATURE_COLUMNS = [
    "EngagementScore", "RelationshipStrengthIndex", "ProductUtilizationScore",
    "LoyaltyScore", "PremiumRiskScore", "FinancialCommitmentIndex",
    "ActivityIntensityScore", "ProductDepthIndex", "StabilityScore",
    "ChurnRiskCategory", "BalanceSalaryRatio", "AgeSegment",
]

# --- feature weights --------------------------------------------------------
ENGAGEMENT_WEIGHTS = {"IsActiveMember": 0.40, "NumOfProducts": 0.30, "HasCrCard": 0.15, "Tenure": 0.15}
RELATIONSHIP_WEIGHTS = {"Tenure": 0.35, "NumOfProducts": 0.30, "Balance": 0.20, "CreditScore": 0.15}
LOYALTY_WEIGHTS = {"Tenure": 0.40, "IsActiveMember": 0.35, "NumOfProducts": 0.25}
FINANCIAL_COMMITMENT_WEIGHTS = {"Balance": 0.50, "EstimatedSalary": 0.30, "NumOfProducts": 0.20}
STABILITY_WEIGHTS = {"CreditScore": 0.35, "Tenure": 0.30, "Balance": 0.20, "EstimatedSalary": 0.15}
UTILIZATION_CARD_BOOST = 0.30      # (1 + 0.30 * HasCrCard)
UTILIZATION_ACTIVE_FLOOR = 0.70    # (0.70 + 0.30 * IsActiveMember)
UTILIZATION_ACTIVE_WEIGHT = 0.30
INTENSITY_PRODUCT_WEIGHT = 0.50
INTENSITY_CARD_WEIGHT = 0.50
INTENSITY_TENURE_BOOST = 0.20
DEPTH_NO_CARD_FACTOR = 0.6
RISK_CATEGORY_CAP = 4
# Age segment: right-closed bins (17,30] (30,45] (45,60] (60,120] -> 0..3
AGE_SEGMENT_EDGES = [17, 30, 45, 60, 120]

# --- KPI thresholds (name, green, amber, lower_is_better) -------------------
KPI_THRESHOLDS = [
    ("EngagementRetentionRatio", 0.70, 0.50, False),
    ("ProductDepthIndex_portfolio", 0.55, 0.40, False),
    ("RelationshipStrengthIndex_avg", 0.60, 0.45, False),
    ("PremiumChurnRiskScore", 0.20, 0.35, True),
    ("CreditCardStickinessScore", 0.65, 0.50, False),
    ("ActiveLoyaltyIndex", 0.60, 0.45, False),
    ("CustomerLifetimeStabilityIndicator", 0.65, 0.50, False),
    ("BehavioralRiskScore", 0.25, 0.40, True),
]
RAG_GREEN = "🟢 Green"
RAG_AMBER = "🟡 Amber"
RAG_RED = "🔴 Red"

# KPI report lines: (order, threshold key, name, display kind, formula, interpretation)
KPI_REPORT = [
    (1, "EngagementRetentionRatio", "Engagement Retention Ratio", "pct",
     "Active & Retained / Total Customers", "% of customers who are engaged AND retained"),
    (2, "ProductDepthIndex_portfolio", "Product Depth Index", "pct",
     "mean(NumOfProducts) / 4", "Average product penetration per customer"),
    (3, "RelationshipStrengthIndex_avg", "Avg Relationship Strength Index", "num",
     "mean(RelationshipStrengthIndex)", "Average depth of customer-bank relationship"),
    (4, "PremiumChurnRiskScore", "Premium Churn Risk Score", "pct",
     "Churned(Balance>P75) / Total(Balance>P75)", "Churn rate among top-quartile balance customers"),
    (5, "CreditCardStickinessScore", "Credit Card Stickiness Score", "pct",
     "Retained(HasCrCard=1) / Total(HasCrCard=1)", "Retention rate among credit card holders"),
    (6, "ActiveLoyaltyIndex", "Active Loyalty Index", "num",
     "mean(LoyaltyScore) × Active_Rate", "Loyalty score weighted by actual activity level"),
    (7, "CustomerLifetimeStabilityIndicator", "Customer Lifetime Stability Indicator", "num",
     "mean(StabilityScore) × (1 - ChurnRate)", "Portfolio stability adjusted for actual churn"),
    (8, "BehavioralRiskScore", "Behavioral Risk Score", "pct",
     "Inactive(Balance>P50) / Total Customers", "Share of disengaged mid-to-high-balance customers"),
]
KPI_PREMIUM_PERCENTILE = 0.75
KPI_BEHAVIOR_PERCENTILE = 0.50
MAX_PRODUCTS = 4.0
CHURN_BENCHMARK = 0.20

# --- EDA bands -------------------------------------------------------------
AGE_GROUP_EDGES = [17, 30, 40, 50, 60, 120]
AGE_GROUP_LABELS = ["18-30", "31-40", "41-50", "51-60", "60+"]
RISK_LABELS = ["Very Low", "Low", "Moderate", "High", "Critical"]
PRODUCT_LABELS = ["1 Product", "2 Products", "3 Products", "4 Products"]
CORRELATION_COLUMNS = [
    "CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard",
    "IsActiveMember", "EstimatedSalary", "Exited", "EngagementScore",
    "LoyaltyScore", "StabilityScore", "FinancialCommitmentIndex", "PremiumRiskScore",
]
EXPLORER_COLUMNS = [
    "CustomerId", "Surname", "Geography", "Gender", "Age", "Tenure", "Balance",
    "NumOfProducts", "HasCrCard", "IsActiveMember", "CreditScore", "Exited",
]
EXPLORER_LIMIT = 500
SLICE_DEFAULT_AGE = (18, 80)
SLICE_DEFAULT_TENURE = (0, 10)

# --- segmentation ------------------------------------------------------------
SEGMENT_FEATURES = [
    "EngagementScore", "RelationshipStrengthIndex", "ProductUtilizationScore",
    "LoyaltyScore", "PremiumRiskScore", "FinancialCommitmentIndex",
    "ActivityIntensityScore", "StabilityScore", "BalanceSalaryRatio",
]
PROFILE_EXTRA = ["Exited", "Age", "Balance", "Tenure"]
N_CLUSTERS = 6
KMEANS_RESTARTS = 15
OPTIMAL_K_RANGE = list(range(3, 10))
OPTIMAL_K_RESTARTS = 10
SEED = 42

# Persona rules in declared order: (persona, feature, lo, hi), inclusive ranges
PERSONA_RULES = [
    ("Loyal Active Customers", "EngagementScore", 0.55, 1.0),
    ("Loyal Active Customers", "LoyaltyScore", 0.50, 1.0),
    ("Multi-Product Loyalists", "ProductUtilizationScore", 0.40, 1.0),
    ("Multi-Product Loyalists", "LoyaltyScore", 0.55, 1.0),
    ("Premium Disengaged", "FinancialCommitmentIndex", 0.38, 1.0),
    ("Premium Disengaged", "ActivityIntensityScore", 0.0, 0.30),
    ("Silent Churn Risk", "EngagementScore", 0.0, 0.30),
    ("Silent Churn Risk", "FinancialCommitmentIndex", 0.0, 0.35),
    ("Low-Value High-Risk", "FinancialCommitmentIndex", 0.0, 0.28),
    ("Low-Value High-Risk", "PremiumRiskScore", 0.04, 1.0),
    ("Young Digital Customers", "StabilityScore", 0.0, 0.52),
    ("Young Digital Customers", "ProductDepthIndex", 0.0, 0.18),
]

# --- machine learning ----------------------------------------------------------
ML_FEATURES = [
    "CreditScore", "Age", "Tenure", "Balance", "NumOfProducts",
    "HasCrCard", "IsActiveMember", "EstimatedSalary",
    "EngagementScore", "RelationshipStrengthIndex", "ProductUtilizationScore",
    "LoyaltyScore", "PremiumRiskScore", "FinancialCommitmentIndex",
    "ActivityIntensityScore", "ProductDepthIndex", "StabilityScore",
    "BalanceSalaryRatio", "AgeSegment", "ChurnRiskCategory",
    "Geo_Germany", "Geo_Spain", "Gender_Male",
]
# levels of a category that may become columns
MAX_LEVELS = 10_000
TEST_FRACTION = 0.20
CV_FOLDS = 5
SMOTE_RATIO = 0.75
SMOTE_NEIGHBOURS = 5
GBT_POS_WEIGHT = 4.0
GBT_LEAVES = 63
# thresholds of a feature that a single tree looks at: every one between two values, up to these
TREE_MAX_BINS = 4096
GBT_MIN_ROWS = 20
TUNE_ITERATIONS = 10
TUNE_FOLDS = 3

# Full model settings (C=1 logistic, depth-8 tree, 300-tree forest, two boosters)
MODEL_SETTINGS = {
    "LogisticRegression": {"C": 1.0, "max_iter": 1000},
    "DecisionTree": {"max_depth": 8, "min_leaf": 10},
    "RandomForest": {"n_trees": 300, "max_depth": 12, "min_leaf": 5},
    "GBT_LevelWise": {"rounds": 300, "max_depth": 6, "step": 0.05, "subsample": 0.8,
                      "colsample": 0.8},
    "GBT_Balanced": {"rounds": 300, "max_depth": 6, "step": 0.05, "leaves": GBT_LEAVES, "min_rows": GBT_MIN_ROWS},
}
# Light settings, for smoke runs that ask for them (see plans/q_ml.py); never the default
MODEL_SETTINGS_LIGHT = {
    "LogisticRegression": {"C": 1.0, "max_iter": 100},
    "DecisionTree": {"max_depth": 8, "min_leaf": 10},
    "RandomForest": {"n_trees": 20, "max_depth": 8, "min_leaf": 5},
    "GBT_LevelWise": {"rounds": 20, "max_depth": 4, "step": 0.1, "subsample": 0.8,
                      "colsample": 0.8},
    "GBT_Balanced": {"rounds": 20, "max_depth": 4, "step": 0.1},
}
TUNE_GRIDS = {
    "RandomForest": {"n_trees": [200, 300, 400], "max_depth": [8, 12, None], "min_leaf": [5, 10]},
    "GBT_LevelWise": {"rounds": [200, 300], "max_depth": [4, 6], "step": [0.03, 0.05, 0.10]},
}
METRIC_TIE_TOLERANCE = 1e-4

# --- fixed-logit score ------------------------------------------------------------
LOGIT_INTERCEPT = -3.80
LOGIT_AGE = 0.048          # * (Age - 38)
LOGIT_AGE_CENTER = 38
LOGIT_CREDIT = 0.006       # * (300 - CreditScore) / 10
LOGIT_TENURE = -0.18
LOGIT_BALANCE = 0.0000030
LOGIT_GERMANY = 0.95
LOGIT_SPAIN = 0.15
LOGIT_ACTIVE = -0.85
LOGIT_PRODUCTS3 = 1.20
LOGIT_CARD = -0.25
LOGIT_LOYALTY = -1.80
LOGIT_FCI_INACTIVE = 0.80
LOGIT_BALANCE_CAP = 200000.0
LOGIT_SALARY_SCALE = 200000.0
LOGIT_CREDIT_SCALE = 850.0
# tiers: (lower bound, tier, action) in descending order; below the last = LOW
RISK_TIERS = [
    (0.65, "CRITICAL", "Assign dedicated Relationship Manager within 48 hours + Premium loyalty offer"),
    (0.45, "HIGH", "Priority reactivation campaign + Cross-sell second banking product"),
    (0.25, "MODERATE", "Digital engagement programme + Monthly relationship check-in"),
]
RISK_TIER_LOW = ("LOW", "Standard monitoring — customer profile is stable and retained")
REPORTED_BANDS = [(0.65, "High (>65%)"), (0.35, "Medium (35-65%)")]
REPORTED_BAND_LOW = "Low (<35%)"
DRIVER_NAMES = [
    "Age Effect", "Credit Effect", "Tenure Effect", "Balance Effect",
    "Geography Effect", "Activity Effect", "Products Effect", "Loyalty Effect",
]
TOP_DRIVERS = 6

# --- retention actions: key, action, channel, timeline, cost tier, description --------
RETENTION_ACTIONS = [
    ("premium_relationship_manager", "Assign dedicated Relationship Manager",
     "Direct outreach (phone + email)", "Within 48 hours", "High",
     "High-balance disengaged customers warrant white-glove attention. "
     "A personal RM touchpoint is proven to reduce churn by 35–45% in this segment."),
    ("loyalty_rewards_upgrade", "Upgrade to Premium Loyalty Programme",
     "Email + in-app notification", "Within 1 week", "Medium",
     "Offer fee-waiver, cashback acceleration, and priority service to long-tenured members."),
    ("credit_card_activation_campaign", "Credit Card Activation + Rewards Push",
     "SMS + mobile push + email", "Within 3 days", "Low",
     "Cardholders who have not used their card in 90+ days respond well to "
     "time-limited cashback offers and spend-linked rewards."),
    ("cross_sell_second_product", "Cross-sell Second Banking Product",
     "Branch + digital assistant", "Within 2 weeks", "Low",
     "Single-product customers are the highest churn risk. "
     "Introducing a savings account, personal loan, or investment product "
     "doubles the switching cost."),
    ("digital_engagement_onboarding", "Digital Engagement Campaign + Mobile Onboarding",
     "App notification + email series", "Immediate", "Very Low",
     "Young customers respond to digital-first engagement. "
     "Offer gamified savings goals, spending insights, and app-exclusive benefits."),
    ("reactivation_outreach", "Inactive Member Reactivation Outreach",
     "Phone + email + direct mail", "Within 1 week", "Medium",
     "Proactively contact inactive members with a 'We miss you' message "
     "and a time-sensitive re-engagement incentive (e.g., fee waiver, bonus interest)."),
    ("product_simplification", "Product Simplification & Rationalisation Review",
     "Branch appointment", "Within 2 weeks", "Medium",
     "Customers with 3–4 products often churn due to complexity. "
     "A product review meeting to consolidate or optimise their portfolio "
     "can significantly improve satisfaction."),
    ("geographic_targeted_offer", "Region-Specific Retention Offer (Germany)",
     "Email + direct mail", "Within 2 weeks", "Medium",
     "German customers churn at higher rates. Localised offers "
     "addressing competitive differentiation (better rates, local partnerships) "
     "can address market-specific attrition drivers."),
    ("senior_wealth_planning", "Senior Customer Wealth Planning Session",
     "Branch + phone consultation", "Within 1 month", "High",
     "Customers aged 50+ with high balances are likely evaluating "
     "retirement / inheritance planning. Proactive wealth advisory "
     "conversations can lock in these assets long-term."),
    ("watch_and_monitor", "Monitor & Automated Early Warning",
     "CRM flag + quarterly review", "Ongoing", "Negligible",
     "Low-risk customers who fall below engagement thresholds should "
     "be flagged in CRM for automated monitoring and quarterly check-in."),
]

URGENCY_ICONS = [("CRITICAL", "🔴"), ("HIGH", "🟠"), ("MEDIUM", "🟡"), ("LOW", "🟢"), ("MONITOR", "⚪")]
URGENCY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "MONITOR"]

# Rule table in evaluation order: (rule_id, urgency, primary, secondary, rationale)
RETENTION_RULES = [
    (1, "CRITICAL", "premium_relationship_manager", "loyalty_rewards_upgrade",
     "High-balance + inactive — AUM flight risk"),
    (2, "HIGH", "product_simplification", "loyalty_rewards_upgrade",
     "3+ products with high churn risk category — complexity churn"),
    (3, "HIGH", "geographic_targeted_offer", "reactivation_outreach",
     "German market + inactive — regional churn risk"),
    (4, "HIGH", "cross_sell_second_product", "digital_engagement_onboarding",
     "Single product + early tenure — highest switching risk segment"),
    (5, "MEDIUM", "senior_wealth_planning", "loyalty_rewards_upgrade",
     "50+ age with high balance — retirement planning migration risk"),
    (6, "MEDIUM", "credit_card_activation_campaign", "reactivation_outreach",
     "Card holder + inactive — card dormancy precedes full attrition"),
    (7, "MEDIUM", "reactivation_outreach", "cross_sell_second_product",
     "Low engagement score — disengagement pattern detected"),
    (8, "LOW", "digital_engagement_onboarding", "cross_sell_second_product",
     "Young customer — digital engagement programme applicable"),
    (0, "MONITOR", "watch_and_monitor", None, "Standard monitoring"),
]
RULE_HIGH_BALANCE = 50_000
RULE_SENIOR_AGE = 50
RULE_YOUNG_AGE = 30
RULE_EARLY_TENURE = 3
RULE_LOW_ENGAGEMENT = 0.35
RULE_RISK_CATEGORY = 3
RULE_MULTI_PRODUCTS = 3
# Value used for a rule input when the column is absent from the frame
RULE_ABSENT_DEFAULTS = {
    "Balance": 0, "IsActiveMember": 1, "NumOfProducts_rule2": 1, "NumOfProducts_rule4": 2,
    "ChurnRiskCategory": 0, "Tenure": 5, "Age_rule5": 30, "Age_rule8": 40, "HasCrCard": 0,
    "EngagementScore": 0.5, "Geography": "",
}

# --- explainability ----------------------------------------------------------------
DRIVER_NARRATIVES = [
    ("Age",
     "Age is the strongest churn predictor. Customers aged 45–60 exhibit "
     "significantly higher churn rates, likely due to evolving financial needs, "
     "retirement planning migration, or competitor wealth-management offerings."),
    ("IsActiveMember",
     "Member activity status is a binary leading indicator of churn. Inactive "
     "customers are ~3× more likely to exit the bank within 12 months. "
     "Reactivation campaigns targeting this cohort should be a top retention priority."),
    ("Balance",
     "High-balance customers who are disengaged represent the most financially "
     "damaging churn segment. AUM outflow from a single premium customer can exceed "
     "the retention cost of 20 standard customers."),
    ("NumOfProducts",
     "Customers with exactly 1 product have the highest churn risk. "
     "Customers with 2 products are the most stable. Paradoxically, 3–4 "
     "product customers also churn more — suggesting product complexity "
     "or forced cross-sell leads to dissatisfaction."),
    ("Geography",
     "German customers churn at a significantly higher rate than French or Spanish "
     "customers. This may reflect market competition, regulatory differences, or "
     "suboptimal product-market fit in the German segment."),
    ("CreditScore",
     "Below-average credit scores correlate with higher churn, possibly driven "
     "by credit denial experiences or migration to specialist lenders."),
    ("Tenure",
     "Shorter tenure is associated with higher churn. Customers in the first "
     "2 years are the most vulnerable. Early lifecycle engagement programmes "
     "are critical to survival past this honeymoon period."),
    ("EngagementScore",
     "The composite Engagement Score is among the top engineered predictors. "
     "Customers with ES < 0.35 are at disproportionate churn risk regardless "
     "of balance or tenure."),
]
DEFAULT_NARRATIVE = "Feature contributes significantly to churn prediction."
DIRECTION_UP = "⬆ Increases Churn Risk"
DIRECTION_DOWN = "⬇ Reduces Churn Risk"
SHAP_TOP = 15
ROW_DRIVERS_TOP = 8
DRIVER_REPORT_TOP = 5
IMPORTANCE_TOP = 15

# Feature type families for importance breakdown
FEATURE_TYPES = [
    ("Age", "Raw"), ("Balance", "Raw"), ("FinancialCommitmentIndex", "Engineered"),
    ("CreditScore", "Raw"), ("EstimatedSalary", "Raw"), ("Tenure", "Raw"),
    ("RelationshipStrengthIndex", "Engineered"), ("StabilityScore", "Engineered"),
    ("EngagementScore", "Engineered"), ("NumOfProducts", "Raw"),
    ("BalanceSalaryRatio", "Engineered"), ("LoyaltyScore", "Engineered"),
    ("AgeSegment", "Engineered"), ("Geo_Germany", "Derived"), ("ChurnRiskCategory", "Engineered"),
    ("HasCrCard", "Raw"), ("IsActiveMember", "Raw"), ("ProductUtilizationScore", "Engineered"),
    ("PremiumRiskScore", "Engineered"), ("ActivityIntensityScore", "Engineered"),
    ("ProductDepthIndex", "Engineered"), ("Geo_Spain", "Derived"), ("Gender_Male", "Derived"),
]

# ===========================================================================
# Tunables for scale (not part of the reproduced behaviour)
# ===========================================================================
# Quantile selection: buckets per narrowing pass and the bracket size below
# which exact values are aggregated instead of bucket counts.
QUANTILE_BUCKETS = 2048
QUANTILE_EXACT_BELOW = 20_000
# Groups of a grouped quantile whose brackets may be kept on the driver; more are kept in a table
DRIVER_STAT_GROUPS = 64
# Rows a side may have to be broadcast without a size check
BROADCAST_ROW_LIMIT = 1_000_000

# Light search, for smoke runs that ask for it
TUNE_GRIDS_LIGHT = {
    "RandomForest": {"n_trees": [10, 20], "max_depth": [4, 8], "min_leaf": [5, 10]},
    "GBT_LevelWise": {"rounds": [10, 20], "max_depth": [3, 4], "step": [0.1]},
}
TUNE_ITERATIONS_LIGHT = 3
TUNE_FOLDS_LIGHT = 2
CV_FOLDS_LIGHT = 2

# Linear model explained by the linear-SHAP queries: the linear terms of the fixed logit
LINEAR_SHAP_COEFS = [
    ("Age", 0.048), ("CreditScore", -0.0006), ("Tenure", -0.18), ("Balance", 0.000003),
    ("IsActiveMember", -0.85), ("HasCrCard", -0.25), ("Geo_Germany", 0.95), ("Geo_Spain", 0.15),
]
# Rows per partition of the cached training frame that iterative fitters scan once per iteration
ML_ROWS_PER_PARTITION = 250_000
# Driver threads submitting independent model fits (models, folds, search points) concurrently
ML_PARALLELISM = 5
# Exact k-NN (SMOTE): rows of a leaf and of a block per co-group side, leaves probed first
KNN_BLOCK = 4096
KNN_FIRST_PROBES = 3
