import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from prefloom.session import local_session

    s = local_session(cpus="*", shuffle_partitions=8)
    yield s
    s.stop()
