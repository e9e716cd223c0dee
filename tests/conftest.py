import pytest

from loomwright.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", partitions=4)
    yield s
    s.stop()
