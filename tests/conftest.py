import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("FRAMELOOM_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from frameloom.session import local_session

    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
