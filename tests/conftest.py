import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from panelspark.session import local_session

    s = local_session("tests", cores=4, shuffle_partitions=4, memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest of the given table directories; tests on it are skipped where it is missing."""
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no table directory")
    return d
