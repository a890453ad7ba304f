import pytest

from noticeboard.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("noticeboard-tests", cpus=8, partitions=4)
