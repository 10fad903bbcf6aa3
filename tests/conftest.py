import pytest


@pytest.fixture(scope="session")
def spark():
    from textlake.plans import session

    spark = session("local[4]", 4, **{"spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
