import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from postmill.session import build_session

    session = build_session("tests", shuffle_partitions=4, **{"spark.driver.memory": "4g"})
    yield session
    session.stop()
