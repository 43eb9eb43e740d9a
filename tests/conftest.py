import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cadenza.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(os.environ.get("TEST_CPUS", "4"), "cadenza-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
