import pytest

from seiche.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores="4", shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s
