import pytest

from millrace.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("4", shuffle_partitions=4, driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


SMALL = "/root/testdata/sf0.001"
