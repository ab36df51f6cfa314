import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from kindred.session import session

    conf = {"spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.log.level": "ERROR", "spark.sql.warehouse.dir": "/tmp/kindred-warehouse"}
    made = session("tests", "local[4]", **conf)
    yield made
    made.stop()
