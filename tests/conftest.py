import pytest

from spandrel.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("4", 4, "3g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    return s
