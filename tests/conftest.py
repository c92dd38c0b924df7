import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from churnlake.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="churnlake-tests")
    s.conf.set("spark.churnlake.models", "light")  # the suite checks properties that hold for any settings
    yield s
    s.stop()
