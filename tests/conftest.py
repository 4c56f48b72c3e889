import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from logevidence.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=4, app="logevidence-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logevidence-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="logevidence-test-")
