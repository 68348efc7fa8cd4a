import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerlake.session import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    s = session("tests", cpus=4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.local.dir": str(folder), "spark.sql.warehouse.dir": str(folder / "warehouse")})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF
