import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loadkit.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="loadkit-tests-")
    s = build_session("loadkit-tests", master="local[4]", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": shared,
                             "spark.sql.autoBroadcastJoinThreshold": "-1"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tmp_shared(spark):
    from loadkit.session import scratch_path
    return scratch_path(spark, "test")
