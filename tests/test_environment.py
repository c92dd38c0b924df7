"""The derived base does not depend on the session time zone or on ANSI mode."""

from churnlake.sources.base import customer_base
from tests.conftest import SF_SMALL


def _rows(spark):
    return sorted(tuple(r) for r in customer_base(spark, SF_SMALL).collect())


def test_base_is_time_zone_and_ansi_independent(spark):
    ref = _rows(spark)
    tz, ansi = spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        assert _rows(spark) == ref
        spark.conf.set("spark.sql.ansi.enabled", "false")
        assert _rows(spark) == ref
    finally:
        spark.conf.set("spark.sql.session.timeZone", tz)
        spark.conf.set("spark.sql.ansi.enabled", ansi)
