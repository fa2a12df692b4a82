import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from threadlens.session import get_spark, shared_dir
    s = get_spark(os.environ.get("TEST_MASTER", "local[*]"), app="threadlens-tests", shuffle_partitions=8,
                  extra={"spark.sql.shuffle.partitions": "8"})
    shared_dir(s)
    yield s
    s.stop()
