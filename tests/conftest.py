import pytest

from siftline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "siftline-tests")
    yield session
    session.stop()
