import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from lumigrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("lumigrid-tests", cpus=8)
    session.sparkContext.setLogLevel("ERROR")
    return session
