import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cohortlens.session import get_session

    base = tmp_path_factory.mktemp("spark")
    session = get_session(
        "local[4]", "tests", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": f"file://{base}/warehouse", "spark.checkpoint.dir": f"file://{base}/shared", "spark.driver.memory": "3g",
        }
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
