"""Feature stage as SQL CTEs (DuckDB dialect), mirroring operators/features.py."""

from __future__ import annotations


def _n(x: str, k: str, p: str = "s1") -> str:
    return f"(CASE WHEN {p}.mx_{k} = {p}.mn_{k} THEN ({x}) * CAST(0.0 AS DOUBLE) ELSE (({x}) - {p}.mn_{k}) / ({p}.mx_{k} - {p}.mn_{k}) END)"


def D(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


INV_K = "CAST(1.0 AS DOUBLE) / (CreditScore + 1)"
DEPTH = "NumOfProducts * (Tenure + 1)"
BSR = "Balance / (EstimatedSalary + 1)"
PASS1 = {"T": "Tenure", "P": "NumOfProducts", "B": "Balance", "K": "CreditScore", "S": "EstimatedSalary",
         "INV_K": INV_K, "DEPTH": DEPTH, "BSR": BSR}


def feat_sql(src: str = "base", out: str = "feat") -> str:
    """Feature CTEs whose last CTE ``out`` has exactly base + 12 feature columns."""
    s1 = ", ".join(f"min({e}) AS mn_{k}, max({e}) AS mx_{k}" for k, e in PASS1.items())
    nP, nT, nB, nK, nS = (_n(PASS1[k], k) for k in ["P", "T", "B", "K", "S"])

    def flag(c: str) -> str:
        return f"coalesce(CAST(({c}) AS INTEGER), 0)"

    points = f"({flag('IsActiveMember = 0')} * 2 + {flag('Age > 50')} + {flag('NumOfProducts >= 3')} + {flag('Balance = 0')} + {flag('Tenure < 2')})"
    return f"""
{out}_p1 AS (
  SELECT {src}.*,
    {D(0.4)} * IsActiveMember + {D(0.3)} * {nP} + {D(0.15)} * HasCrCard + {D(0.15)} * {nT} AS EngagementScore,
    {D(0.35)} * {nT} + {D(0.3)} * {nP} + {D(0.2)} * {nB} + {D(0.15)} * {nK} AS RelationshipStrengthIndex,
    {nP} * (1 + {D(0.3)} * HasCrCard) * ({D(0.7)} + {D(0.3)} * IsActiveMember) AS x_PUS,
    {D(0.4)} * {nT} + {D(0.35)} * IsActiveMember + {D(0.25)} * {nP} AS LoyaltyScore,
    {nB} * (1 - IsActiveMember) * {_n(INV_K, 'INV_K')} AS x_PRS,
    {D(0.5)} * {nB} + {D(0.3)} * {nS} + {D(0.2)} * {nP} AS FinancialCommitmentIndex,
    IsActiveMember * ({D(0.5)} * {nP} + {D(0.5)} * HasCrCard) * (1 + {D(0.2)} * {nT}) AS x_AIS,
    {_n(DEPTH, 'DEPTH')} * (CASE WHEN HasCrCard = 1 THEN {D(1.0)} ELSE {D(0.6)} END) AS x_PDI,
    {D(0.35)} * {nK} + {D(0.3)} * {nT} + {D(0.2)} * {nB} + {D(0.15)} * {nS} AS StabilityScore,
    CAST(least({points}, 4) AS INTEGER) AS ChurnRiskCategory,
    {_n(BSR, 'BSR')} AS BalanceSalaryRatio,
    CAST(CASE WHEN Age > 17 AND Age <= 30 THEN 0 WHEN Age > 30 AND Age <= 45 THEN 1
              WHEN Age > 45 AND Age <= 60 THEN 2 WHEN Age > 60 AND Age <= 120 THEN 3 END AS INTEGER) AS AgeSegment
  FROM {src} CROSS JOIN (SELECT {s1} FROM {src}) s1
),
{out}_s2 AS (SELECT min(x_PUS) AS mn_PUS, max(x_PUS) AS mx_PUS, min(x_PRS) AS mn_PRS, max(x_PRS) AS mx_PRS,
                    min(x_AIS) AS mn_AIS, max(x_AIS) AS mx_AIS, min(x_PDI) AS mn_PDI, max(x_PDI) AS mx_PDI FROM {out}_p1),
{out} AS (
  SELECT p.* EXCLUDE (x_PUS, x_PRS, x_AIS, x_PDI, EngagementScore, RelationshipStrengthIndex, LoyaltyScore,
                      FinancialCommitmentIndex, StabilityScore, ChurnRiskCategory, BalanceSalaryRatio, AgeSegment),
         p.EngagementScore, p.RelationshipStrengthIndex,
         {_n('p.x_PUS', 'PUS', 's2')} AS ProductUtilizationScore,
         p.LoyaltyScore,
         {_n('p.x_PRS', 'PRS', 's2')} AS PremiumRiskScore,
         p.FinancialCommitmentIndex,
         {_n('p.x_AIS', 'AIS', 's2')} AS ActivityIntensityScore,
         {_n('p.x_PDI', 'PDI', 's2')} AS ProductDepthIndex,
         p.StabilityScore, p.ChurnRiskCategory, p.BalanceSalaryRatio, p.AgeSegment
  FROM {out}_p1 p CROSS JOIN {out}_s2 s2
)"""
