import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from supplyspark.session import build_session, release_staged

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="supplyspark-test-"),
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="supplyspark-wh-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release_staged()
    session.stop()
