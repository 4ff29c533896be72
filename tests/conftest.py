import pytest

from strandline.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g", 4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
