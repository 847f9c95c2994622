import pytest

from failsift.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="8", shuffle_partitions=8, name="failsift-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
