import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[1], os.environ.get("PYTHONPATH", "")])  # for the workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from weftline.session import build_session

    s = build_session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return os.environ.get("WEFTLINE_TESTDATA", "/root/testdata/sf0.001")
