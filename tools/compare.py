"""Order-insensitive comparison of a Spark result with a DuckDB result (6-digit floats, NaN = null)."""

from __future__ import annotations

import math

import pandas as pd


def norm_value(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm_value(x) for x in v)
    if hasattr(v, "tolist") and getattr(v, "ndim", 0) > 0:
        return tuple(norm_value(x) for x in v.tolist())
    if hasattr(v, "item"):
        return norm_value(v.item())
    return v


def rows_of(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = [tuple(norm_value(x) for x in rec) for rec in pdf[cols].itertuples(index=False)]
    return cols, sorted(out, key=repr)


def diff(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> str | None:
    sc, sr = rows_of(spark_pdf)
    oc, orr = rows_of(oracle_pdf)
    if sc != oc:
        return f"columns spark={sc} oracle={oc}"
    if len(sr) != len(orr):
        return f"rows spark={len(sr)} oracle={len(orr)}"
    bad = [(a, b) for a, b in zip(sr, orr) if a != b]
    if bad:
        return f"{len(bad)} rows differ; first spark={bad[0][0]} oracle={bad[0][1]}"
    return None
