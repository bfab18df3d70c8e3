"""A session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    """A local session."""
    from pagelathe.sources.tables import local_session

    s = local_session("8", memory="6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    """The smallest tables."""
    return "/root/testdata/sf0.001"
