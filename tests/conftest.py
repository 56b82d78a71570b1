import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from kindred.session import local_session

    s = local_session(cores="4", shuffle=4, memory="3g", name="tests")
    yield s
    s.stop()
