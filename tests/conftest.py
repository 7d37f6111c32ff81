import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wordtally.session import local_session

    s = local_session(4, app="wordtally-tests", **{"spark.sql.shuffle.partitions": "8"})
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wt-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="wt-test-")


SF = "/root/testdata/sf0.001"
