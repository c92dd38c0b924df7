"""Every query without an oracle runs end to end and returns rows."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

ROWS_ONLY = sorted(set(E.queries()) - set(E.oracle_sql()))


@pytest.mark.parametrize("key", ROWS_ONLY)
def test_rows_only_query_runs(spark, key):
    n = E.queries()[key](spark, SF_SMALL).count()
    assert n > 0
