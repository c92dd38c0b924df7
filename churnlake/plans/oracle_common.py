"""Small helpers to write oracle SQL text."""

from __future__ import annotations


def sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("'", "''") + "'"


def values_cte(name: str, cols: list[str], rows: list[tuple]) -> str:
    body = ",\n  ".join("(" + ", ".join(sql_lit(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(cols)}) AS (VALUES\n  {body}\n)"


def D(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"
