import pytest

from boxledger.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4, app="boxledger-tests")
    yield session
    session.stop()
