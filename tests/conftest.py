import pytest

from leadloom.session import builder, ship


@pytest.fixture(scope="session")
def spark():
    session = builder("4", 4).config("spark.driver.memory", "3g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
