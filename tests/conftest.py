import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corvane.session import get_spark

    root = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.local.dir": str(root / "local"), "spark.sql.warehouse.dir": str(root / "warehouse"), "spark.checkpoint.dir": str(root / "shared"), "spark.ui.showConsoleProgress": "false"}
    session = get_spark("local[4]", "tests", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
