import pytest

from docloom import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", "tests", spark_sql_shuffle_partitions="4", spark_driver_memory="4g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
