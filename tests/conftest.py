import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")
ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from quillstone.session import drop_own_root, local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 4, **{"spark__sql__shuffle__partitions": "4", "spark__ui__showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
    drop_own_root()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
