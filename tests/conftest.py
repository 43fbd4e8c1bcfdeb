import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rasterloom.session import build

    shared = str(tmp_path_factory.mktemp("shared"))
    conf = {"spark.ui.enabled": "false", "spark.checkpoint.dir": shared, "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = build("tests", "local[4]", 8, **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
