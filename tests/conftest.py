import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session

    shared = tmp_path_factory.mktemp("shared")
    spark = session("tests", cores=8, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(shared), "spark.sql.warehouse.dir": str(shared / "warehouse")})
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
