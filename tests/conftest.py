import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from phenoframe.session import get_session
    s = get_session("local[4]", app="phenoframe-tests", shuffle_partitions=4)
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="phenoframe-test-ckpt-", dir="/tmp"))
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
