import pytest

from calibra.session import session


@pytest.fixture(scope="session")
def spark():
    return session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
