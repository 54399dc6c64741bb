import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from veldspar.session import local_session

    s = local_session(os.environ.get("TEST_CPUS", "4"), partitions=4, memory="3g")
    yield s
    s.stop()
