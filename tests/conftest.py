import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tessellum.session import get_spark

    session = get_spark("tests", cpus=8, partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
