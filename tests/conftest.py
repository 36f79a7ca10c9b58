import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from archgraph.session import session

    root = tmp_path_factory.mktemp("spark")
    spark = session("tests", cores=int(os.environ.get("TEST_CORES", "4")), shuffle_partitions=4, **{"spark.checkpoint.dir": str(root / "shared"), "spark.sql.warehouse.dir": str(root / "warehouse"), "spark.driver.memory": "4g"})
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    found = "/root/testdata/sf0.001"
    if not os.path.isdir(found):
        pytest.skip("no test tables here")
    return found
