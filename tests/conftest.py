import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from strata.session import build_session

    s = build_session("local[4]", app_name="strata-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data_dir():
    if not os.path.isdir(SMOKE_DIR):
        pytest.skip("test data folder not present")
    return SMOKE_DIR
