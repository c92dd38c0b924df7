"""Exact distributed order statistics against numpy."""

import numpy as np
import pytest

from churnlake.functions.stats import exact_order_stats, exact_quantiles


def _frame(spark, values, groups=None):
    rows = [(None if v is None else float(v), (groups[i] if groups else "a")) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "x double, g string")


@pytest.mark.parametrize("buckets,exact_below", [(2048, 100000), (4, 3)])
def test_quantiles_match_numpy_with_hot_value_and_nulls(spark, buckets, exact_below):
    rng = np.random.default_rng(7)
    vals = list(rng.normal(size=300) * 1000) + [5.0] * 150 + [None] * 20   # a third of the rows share one value
    df = _frame(spark, vals)
    probs = [0.0, 0.25, 1 / 3, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, {f"p{i}": ("x", p) for i, p in enumerate(probs)}, buckets=buckets, exact_below=exact_below).first()
    clean = np.array([v for v in vals if v is not None])
    for i, p in enumerate(probs):
        assert got[f"p{i}"] == pytest.approx(np.quantile(clean, p), rel=1e-12, abs=1e-9)


def test_grouped_quantiles_and_empty_group(spark):
    vals = [1, 2, 3, 4, 10, 20, None]
    groups = ["a", "a", "a", "a", "b", "b", "c"]
    q = {r["g"]: r["m"] for r in exact_quantiles(_frame(spark, vals, groups), {"m": ("x", 0.5)}, by=["g"]).collect()}
    assert q == {"a": 2.5, "b": 15.0, "c": None}


def test_order_statistics_by_rank(spark):
    vals = [9, 3, 3, 7, 1, 5]
    r = exact_order_stats(_frame(spark, vals), "x", {(): 2}, buckets=2, exact_below=1).first()
    assert r["value"] == 3.0
    out = exact_order_stats(_frame(spark, vals), "x", {(): 99}).first()
    assert out["value"] is None


def test_nan_is_ignored_like_a_missing_value(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4]] + [(float("nan"),)], "x double")
    assert exact_quantiles(df, {"m": ("x", 0.5)}).first()["m"] == 2.5
