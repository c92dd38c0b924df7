"""SQL text (DuckDB dialect) of the derived stages, used as CTEs by the oracles.

These mirror the Spark operators statement by statement so that the driver
can compare the Spark result with an independent engine. Every decimal
constant is written as a double so that both engines do double arithmetic.
"""

from __future__ import annotations

BASE_SQL = """
o AS (
  SELECT o_custkey,
         count(*) AS n_orders,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents,
         count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-08-01 00:00:00') AS n_recent,
         count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-02-01 00:00:00') AS n_active
  FROM orders GROUP BY o_custkey
),
b0 AS (
  SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment, n.n_regionkey,
         coalesce(o.n_orders, 0) AS n_orders,
         CAST(coalesce(o.cents, 0) AS DOUBLE) AS cents,
         coalesce(o.n_recent, 0) AS n_recent,
         coalesce(o.n_active, 0) AS n_active
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN o ON c.c_custkey = o.o_custkey
),
b1 AS (
  SELECT *,
         CASE WHEN n_active > 0 THEN 1 ELSE 0 END AS act,
         CAST(18 + (c_custkey * 37 + c_nationkey * 11) % 63 AS INTEGER) AS age,
         CAST(least(4, greatest(1, n_recent)) AS INTEGER) AS prods,
         CASE WHEN n_regionkey IN (0, 1) THEN 'France' WHEN n_regionkey = 2 THEN 'Germany' ELSE 'Spain' END AS geo
  FROM b0
),
base AS (
  SELECT CAST(c_custkey AS BIGINT) AS CustomerId,
         c_name AS Surname,
         CAST(350 + floor(cents / greatest(n_orders, 1) / CAST(100000.0 AS DOUBLE)) AS INTEGER) AS CreditScore,
         geo AS Geography,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') THEN 'Male' ELSE 'Female' END AS Gender,
         age AS Age,
         CAST(greatest(0, least(10, n_orders - 5)) AS INTEGER) AS Tenure,
         CASE WHEN c_acctbal < 2000 THEN CAST(0.0 AS DOUBLE) ELSE (c_acctbal - CAST(2000.0 AS DOUBLE)) * CAST(30.0 AS DOUBLE) END AS Balance,
         prods AS NumOfProducts,
         CAST(CASE WHEN (c_custkey * 31 + 17) % 97 < 68 THEN 1 ELSE 0 END AS INTEGER) AS HasCrCard,
         CAST(act AS INTEGER) AS IsActiveMember,
         cents / CAST(2500.0 AS DOUBLE) AS EstimatedSalary,
         CAST(CASE WHEN (c_custkey * 7919 + 104729) % 1000 <
              40 + 90 * ((1 - act) * 2 + CAST(age > 50 AS INTEGER) + CAST(prods >= 3 AS INTEGER)
                         + CAST(geo = 'Germany' AS INTEGER)) THEN 1 ELSE 0 END AS INTEGER) AS Exited
  FROM b1
)"""

DIRTY_SQL = """
d0 AS (
  SELECT CustomerId, Surname,
         CASE WHEN CustomerId % 41 = 0 THEN NULL ELSE CreditScore END AS CreditScore,
         CASE WHEN CustomerId % 47 = 0 THEN NULL
              WHEN Geography = 'Germany' AND CustomerId % 3 = 0 THEN ' germany '
              WHEN Geography = 'Spain' AND CustomerId % 5 = 0 THEN 'SPAIN'
              ELSE Geography END AS Geography,
         CASE WHEN CustomerId % 331 = 0 THEN 'Unknown' ELSE Gender END AS Gender,
         CASE WHEN CustomerId % 401 = 0 THEN Age + 80 ELSE Age END AS Age,
         Tenure,
         CASE WHEN CustomerId % 53 = 0 THEN NULL
              WHEN CustomerId % 211 = 0 THEN Balance * CAST(20.0 AS DOUBLE)
              ELSE Balance END AS Balance,
         NumOfProducts,
         CASE WHEN CustomerId % 499 = 0 THEN 2 ELSE HasCrCard END AS HasCrCard,
         IsActiveMember, EstimatedSalary, Exited
  FROM base
),
dirty AS (
  SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE CustomerId % 97 = 0
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
