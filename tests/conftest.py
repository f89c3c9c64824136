import tempfile

import pytest

from csvharbor.session import build_session


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="csvharbor-tests-")
    session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
