import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import build_session

    folder = str(tmp_path_factory.mktemp("shared"))
    return build_session("tests", "8", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": folder})


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.exists():
        pytest.skip("supplied tables are not here")
    return str(DATA)


@pytest.fixture(scope="session")
def data(spark, sf_dir):
    from tidemark.plans.queries import Inputs

    return Inputs(spark, sf_dir)
