"""Randomised: exact_quantiles equals numpy's linear quantile for any data, probability and pass sizes."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlake.functions.stats import exact_quantiles

values = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, derandomize=True)
@given(vals=values, p=st.floats(0.0, 1.0), buckets=st.integers(2, 16), exact_below=st.integers(1, 20))
def test_exact_quantile_matches_numpy(spark, vals, p, buckets, exact_below):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, {"q": ("x", p)}, buckets=buckets, exact_below=exact_below).first()["q"]
    clean = np.array([v for v in vals if v is not None])
    if len(clean) == 0:
        assert got is None
    else:
        assert got == pytest.approx(float(np.quantile(clean, p)), rel=1e-9, abs=1e-6)
