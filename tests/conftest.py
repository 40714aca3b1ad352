import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codeatlas.session import get_session

    # spark.checkpoint.dir is taken from the configuration when set; get_session creates a
    # scratch folder only when it is unset (local runs).
    s = get_session("local[4]", shuffle_partitions=8)
    yield s
    s.stop()
