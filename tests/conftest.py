import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TESSERAL_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from tesseral.session import local_session

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def root():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
