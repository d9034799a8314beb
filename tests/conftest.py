import pytest

from plateworks.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", "tests", str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
