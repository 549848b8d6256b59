import pytest

from claimweave.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    return s
