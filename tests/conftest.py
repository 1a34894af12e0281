import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gaugeflow.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, partitions=4, memory="4g")
    yield session
    session.stop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
