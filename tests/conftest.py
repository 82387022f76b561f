import pytest

from pagewatch.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(app_name="pagewatch-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
