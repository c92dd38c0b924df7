"""Column-expression helpers (JVM-side, codegen friendly; no Python UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lit_d(v: float) -> Column:
    """A double literal (SQL text like ``0.4`` would be DECIMAL)."""
    return F.lit(float(v))


def minmax_norm(x: Column, lo: Column, hi: Column) -> Column:
    """(x - min) / (max - min); a constant column becomes x * 0.0 (null stays null)."""
    return F.when(hi == lo, x * lit_d(0.0)).otherwise((x - lo) / (hi - lo))


def flag(cond: Column) -> Column:
    """Predicate as 0/1 where an unknown (null) comparison counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def right_closed_bin(x: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Label of the right-closed interval (e_i, e_i+1] holding x; null outside."""
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > lo) & (x <= hi)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def rag(value: Column, green: Column, amber: Column, lower_is_better: Column, compat: bool = False) -> Column:
    """Green / Amber / Red status.

    Higher-is-better: Green at >= green, Amber at >= amber, else Red.
    Lower-is-better (intended): Green at <= green, Amber at <= amber, else Red.
    ``compat=True`` keeps the original lower-is-better comparison order, in
    which Amber cannot be reached.
    """
    from churnlake.config import RAG_AMBER, RAG_GREEN, RAG_RED

    if compat:
        low = F.when(value <= amber, RAG_GREEN).when(value <= green, RAG_AMBER).otherwise(RAG_RED)
    else:
        low = F.when(value <= green, RAG_GREEN).when(value <= amber, RAG_AMBER).otherwise(RAG_RED)
    high = F.when(value >= green, RAG_GREEN).when(value >= amber, RAG_AMBER).otherwise(RAG_RED)
    return F.when(lower_is_better, low).otherwise(high)


def r6(c: Column) -> Column:
    """Round to 6 digits: absorbs summation-order noise of distributed sums."""
    return F.round(c, 6)


def present(df, c: str) -> Column:
    """The column with NaN as null (in floating-point columns; others as they are): NaN is a missing value."""
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(F.col(c)), F.col(c))
    return F.col(c)
