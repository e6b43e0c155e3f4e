import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spindle.session import GROUP_ROWS_CONF, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=8, partitions=3)
    yield session
    session.stop()


@pytest.fixture(params=["whole", "split"])
def group_rows(request, spark):
    """Run a test with whole groups, and with groups of more than 12 rows cut into blocks."""
    if request.param == "split":
        spark.conf.set(GROUP_ROWS_CONF, "12")
    yield request.param
    spark.conf.unset(GROUP_ROWS_CONF)


SF = "/root/testdata/sf0.001"
