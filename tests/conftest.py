import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from relgraph.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("relgraph-tests", cores=4, partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
